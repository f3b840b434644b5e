"""Labels of a text's tokens, by two automata that walk the tokens once.

The first is a trie over the lexicon's token sequences (spaces are tokens, so "t2" and "thứ 2" are
different paths): from each token the longest phrase is taken, and each of its words gets the phrase's
class, one letter. The second reads the letters: a rule is a row of letter patterns with a label each,
and from each word the longest rule that fits is taken, the first of equal ones. A word that could mean
something else ("mai", "sáng", "tối", "năm", "qua", "tư") has no rule by itself, but only beside what
makes it a time, or where it begins a clause; so what says nothing about time gets no label.

Tokens are cut by Spark (`text.tokens`); over Arrow, Python sees them once a row and gives numbers back.
Null texts have null tokens; empty ones none. Work is linear in the tokens, and no row is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicon as x
from . import text as tx

#: The labels, in the order of their numbers.
LABELS = (
    "O NUM ORD UNIT DIR_BEFORE DIR_AFTER NOW REL_DAY DEICTIC WEEKDAY DAYGROUP MONTH DOM YEAR HOUR MINUTE SECOND MERIDIEM TIME_NAMED DAYPART "
    "RANGE_START RANGE_END RECUR FREQ TIMES BOUND_START BOUND_END COUNT DUR EXCEPT HOLIDAY JOIN GLUE EDGE CLOCK_OFFSET LUNAR"
).split()
#: Classes of words by letter. Weak words, which need company: r p v k e; the others are strong.
CLASSES = {
    "W": [*x.WEEKDAYS, "thứ2", "thứ3", "thứ4", "thứ5", "thứ6", "thứ7", "t8"],
    "R": [w for w in x.RELATIVE_DAYS if " " in w] + ["hnay", "hqua"], "r": ["mai", "mốt", "kia"], "q": ["qua"], "a": ["nay"],
    "P": ["buổi", "ban"], "p": ["sáng", "trưa", "chiều", "tối", "đêm", "khuya", "sáng sớm", "đêm khuya"], "m": ["am", "pm"],
    "N": ["bây giờ", "bây h", "hiện tại", "ngay bây giờ", "hiện giờ", "lúc này"],
    "k": [w for w in x.NUMBERS if w not in ("năm", "rưỡi")] + [w for w in x.SCALES], "v": ["năm"], "H": ["rưỡi"], "f": ["kém", "hơn"],
    "g": ["giờ"], "h": ["h", "g"], "i": ["phút"], "j": ["p", "ph"], "s": ["giây"], "l": ["tiếng"], "y": ["ngày"], "o": ["hôm", "bữa"], "w": ["tuần"], "t": ["tháng"], "Q": ["quý"],
    "S": ["sau"], "T": ["trước", "trc"], "X": ["nữa"], "n": ["tới"], "z": ["này"], "Z": ["ngoái", "rồi", "kế", "kế tiếp", "sắp tới", "tiếp theo", "vừa rồi", "vừa qua"], "O": ["sang"],
    "G": [*x.DAY_GROUPS], "A": [*x.NAMED_TIMES, *x.NAMED_WINDOWS], "B": [w for w in x.HOLIDAY_OF if not w.startswith("lễ ")], "@": ["lễ"], "e": ["giêng", "chạp"],
    "c": ["mùng", "mồng"], "C": ["rằm"], "L": ["âm lịch", "âm", "âl", "lịch âm", "lịch ta"], "D": ["nhuận"],
    "F": ["từ"], "E": ["đến", "cho đến", "đến hết", "cho đến hết"], "b": ["kể từ", "bắt đầu từ", "bắt đầu", "tính từ"], "M": ["mỗi", "hàng", "hằng", "các", "tất cả các", "mọi"], "I": ["cách"], "J": ["cách đây"],
    "K": ["lần"], "U": ["trong", "trong vòng", "kéo dài", "suốt"], "x": ["trừ", "ngoại trừ", "trừ ra", "ngoài trừ"], "u": ["lúc", "vào", "hồi", "dịp"], "V": ["đầu", "cuối", "giữa"], "Y": ["đầu tiên", "cuối cùng"],
    "&": ["và"], "?": ["thứ"], "~": ["của"], "+": [f"{s} {b}" for s in x.STEMS for b in [*x.BRANCHES, *x.BRANCH_VARIANTS]],
    "^": ["số", "đường", "phố", "ngã ba", "ngã tư", "ngã năm", "ngã sáu", "quận", "phòng", "tầng", "tỉ số", "tỷ số", "phiên bản"],
    # What would else be read into: set phrases without a time.
    "_": [
        "cuối cùng cũng", "thứ tự", "ngày càng", "ngày xưa", "giờ giấc", "tối đa", "tối ưu", "tối thiểu", "sáng tạo", "sáng suốt", "chiều cao",
        "chiều dài", "chiều rộng", "chiều lòng", "mai mối", "hoa mai", "mai vàng", "cây mai", "mai táng", "mai mỉa", "mai danh", "bà mai", "trước mặt", "sau lưng", "đầu tư", "tư vấn", "riêng tư", "ngoài giờ", "lần này", "lần trước", "lần sau", "trong ngày",
    ],
}
#: The letter rules: letters and label, joined by "=", one part after another; "?" makes a part optional.
#: # is a number in digits or words, % one that can be a month or a day in words, | the beginning or end of a clause.
RULES = """
N=NOW
R=REL_DAY
\\|r=REL_DAY
\\|a=REL_DAY
r=REL_DAY (?=u#|#[gh:])=O
\\|q=O (?=\\|)=O
p=DAYPART [raq]=REL_DAY
p=DAYPART R=REL_DAY
P=GLUE p=DAYPART
P=GLUE p=DAYPART [raq]=REL_DAY
P=GLUE p=DAYPART R=REL_DAY
p=DAYPART (?=W|y%|B|wS)=O
p=MERIDIEM (?=#[gh])=O
p=DAYPART (?=F#)=O
\\|p=DAYPART (?=\\|)=O
(?<=u)p=DAYPART (?=[\\|W])=O
M=RECUR p=DAYPART
(?<=p)[raq]=REL_DAY
(?<=[ghm])[ra]=REL_DAY
W+=WEEKDAY [SnzTZq]=DEICTIC? X=DEICTIC?
W+=WEEKDAY w=UNIT [SnzTZqa]=DEICTIC X=DEICTIC?
W+=WEEKDAY d(?![gh:/Hm])=WEEKDAY d(?![gh:/Hm])=WEEKDAY? d(?![gh:/Hm])=WEEKDAY?
W+=WEEKDAY ,\\|=JOIN %(?!K)=WEEKDAY ,\\|=JOIN? %(?!K)=WEEKDAY?
W+=WEEKDAY ,\\|=JOIN (?=W)=O
W+=WEEKDAY &=JOIN (?=W)=O
W+=WEEKDAY Y+=ORD
K=O W+=O
\\^=O d=O /=O d=O
\\^=O d=O -?=O d?=O
[wtv]=UNIT [SnzTZqa]=DEICTIC X=DEICTIC?
O=DEICTIC [wtv]=UNIT
V=EDGE [wtv]=UNIT [SnzTZqa]=DEICTIC? X=DEICTIC?
V=EDGE t=GLUE %=MONTH v=GLUE? D=YEAR?
Y=EDGE [wtv]=UNIT
G+=DAYGROUP [SnzTZ]=DEICTIC? X=DEICTIC?
w=UNIT W+=ORD ~=GLUE? (?=t)=O
w=UNIT %=ORD (?=t)=O
w=UNIT V=EDGE (?=t%)=O
w=UNIT Y+=ORD t(?!%)=UNIT
w=UNIT V=ORD t(?!%)=UNIT
#=HOUR [gh]=GLUE
#=HOUR [gh]=GLUE #=MINUTE i=GLUE?
#=HOUR [gh]=GLUE #=MINUTE i=GLUE? p=MERIDIEM
#=HOUR [gh]=GLUE p=MERIDIEM
#=HOUR [gh]=GLUE H=CLOCK_OFFSET p=MERIDIEM?
#=HOUR [gh]=GLUE f=CLOCK_OFFSET #=MINUTE i=GLUE? p=MERIDIEM?
d=HOUR :=GLUE d=MINUTE p=MERIDIEM?
d=HOUR :=GLUE d=MINUTE :=GLUE d=SECOND p=MERIDIEM?
d=HOUR :?=GLUE d?=MINUTE m=MERIDIEM
#=HOUR H=CLOCK_OFFSET p=MERIDIEM
\\|d=HOUR H=CLOCK_OFFSET (?=\\|)=O
F=RANGE_START #=HOUR E=RANGE_END (?=#[gh])=O
#=HOUR [gh]=GLUE #=MINUTE? p=MERIDIEM? [En-]=RANGE_END (?=#[gh])=O
F=RANGE_START #=HOUR [gh]=GLUE #=MINUTE? p=MERIDIEM? [En-]=RANGE_END (?=#[gh])=O
V=RANGE_START #=HOUR [gh]=GLUE &=RANGE_END (?=#[gh])=O
#=HOUR [gh]=GLUE #=MINUTE? p=MERIDIEM? ,\\|=JOIN (?=#[gh]|W)=O
#=HOUR [gh]=GLUE #=MINUTE? p=MERIDIEM? &=JOIN (?=#[gh]|W)=O
F=RANGE_START (?=#[gh])=O
F=RANGE_START (?=[WVcCBR]|d/|y%|t%|d[tB])=O
T=DIR_BEFORE (?=#[gh]|d:d)=O
S=DIR_AFTER (?=#[gh]p|d:d)=O
y=GLUE #=DOM
y=GLUE d=DOM &=JOIN d=DOM (?=M)=O
y=GLUE (?=B)=O
@=GLUE B+=HOLIDAY
B+=HOLIDAY D=YEAR
B+=HOLIDAY \\++=YEAR
y=GLUE #=DOM E=RANGE_END (?=y)=O
y?=GLUE d=DOM /=GLUE d=MONTH
y?=GLUE d=DOM /=GLUE d=MONTH /=GLUE D=YEAR
y?=GLUE d=DOM -=GLUE d=MONTH -=GLUE D=YEAR
y?=GLUE d=DOM \\.=GLUE d=MONTH \\.=GLUE D=YEAR
D=YEAR -=GLUE d=MONTH -=GLUE d=DOM
\\|d=DOM -=GLUE d=MONTH (?=\\|)=O
d=DOM -=RANGE_END d=DOM /=GLUE d=MONTH
y?=GLUE d=DOM /=GLUE d=MONTH E=RANGE_END (?=d/|y)=O
y?=GLUE d=DOM /=GLUE d=MONTH /=GLUE D=YEAR E=RANGE_END (?=d/|y)=O
d=MONTH /=GLUE D=YEAR
y?=GLUE #=DOM t=GLUE %=MONTH
y?=GLUE #=DOM t=GLUE %=MONTH v=GLUE D=YEAR
y?=GLUE #=DOM t=GLUE %=MONTH E=RANGE_END (?=[ycd])=O
t=GLUE %=MONTH
t=GLUE %=MONTH E=RANGE_END (?=t)=O
t=GLUE %=MONTH v=GLUE D=YEAR
v=GLUE D=YEAR
v=GLUE \\++=YEAR
t=GLUE D=O
B+=HOLIDAY [zSnTZ]=HOLIDAY?
d=DOM B+=HOLIDAY
c=LUNAR d=DOM B+=HOLIDAY?
c=LUNAR #=DOM t=GLUE? %=MONTH? D=LUNAR?
C=LUNAR t=GLUE? %=MONTH?
t=GLUE %=MONTH D=LUNAR
(?<=[dkv])L+=LUNAR
#=NUM [lgisywtvhj]=UNIT [XSn]=DIR_AFTER S?=DIR_AFTER
#=NUM [lgisywtvhj]=UNIT T=DIR_BEFORE
#=NUM [lgisywtvhj]=UNIT #=NUM [lgisywtvhj]=UNIT [XSn]=DIR_AFTER
#=NUM [lgisywtvhj]=UNIT #=NUM [lgisywtvhj]=UNIT T=DIR_BEFORE
S=DIR_AFTER #=NUM [lisywtvj]=UNIT X=DIR_AFTER?
J+=DIR_BEFORE #=NUM [lgisywtvhj]=UNIT
#=NUM [lgisywtvhj]=UNIT b+=DIR_AFTER N=NOW
U+=DUR #=NUM [lgisywtvhj]=UNIT H=NUM?
U+=DUR #=NUM G=UNIT GG=O
u=O #=NUM [y]=UNIT (?=\\|)=O
#=NUM y=UNIT (?=uB)=O
M=RECUR [gisywtvQ]=UNIT
M=RECUR #=NUM [lgisywtv]=UNIT
M=RECUR (?=[WG])=O
M=RECUR (?=pW)=O
I=RECUR [ywt]=UNIT
#=NUM [lgisywtv]=UNIT #=RECUR K=RECUR
#=NUM K=TIMES [/k]=RECUR [gywtv]=UNIT
,\\|=JOIN #=NUM K=TIMES
b+=BOUND_START (?=[dWwtyVcCaR])=O
E+=BOUND_END (?=[dWwtVcCB])=O
n=BOUND_END (?=W)=O
F=BOUND_START [aR]=REL_DAY E=BOUND_END
x+=EXCEPT (?=[WGBwdytcCRV])=O
A+=TIME_NAMED
A+=TIME_NAMED [raq]=REL_DAY
r=REL_DAY (?=[WA])=O
"""
#: Words of an aside that a joining word may stand between, and the labels of days and of hours.
DAYS, CLOCKS = {7, 9, 10, 12, 30}, {14, 18}
FROM, TO, UNTIL = 20, 21, 26


@lru_cache(1)
def trie() -> dict:
    """Token sequences (spaces as one) to classes; a node's class is under None."""
    root: dict = {}
    for letter, phrases in CLASSES.items():
        for phrase in phrases:
            node = root
            for token in re.findall(r"[^\W\d]+|\d+|\s+|.", phrase):
                node = node.setdefault(token, {})
            node.setdefault(None, letter)
    return root


def beginnings(parts: list[tuple[str, bool]]) -> set[str]:
    """The letters that a rule's first word can have; parts are (letters, optional), and ones in (?...) take no word."""
    out: set[str] = set()
    for pattern, optional in parts:
        if pattern.startswith("(?="):
            continue
        own = re.sub(r"\(\?.*?\)", "", pattern).replace("#", "dkv").replace("%", "dkve")
        several = own.startswith("[")
        letters = re.match(r"\[(.*?)\]", own)[1] if several else own
        out |= set(letters.replace("\\", "")) if several or "#" in pattern or "%" in pattern else {letters.lstrip("\\")[0]}
        if not optional and not own.endswith("?"):
            break
    return out


@lru_cache(1)
def rules() -> dict[str, list[tuple[re.Pattern, list[int]]]]:
    """The rules by the letter that they begin with, in their order."""
    number, small = "(?:d|[kv]+r?)", "(?:d|k{1,2}|[ve])"
    out: dict[str, list] = {}
    for line in RULES.strip().splitlines():
        parts = []
        for part in line.split(" "):
            pattern, _, name = part.rpartition("=")
            parts.append((pattern, name.rstrip("?"), name.endswith("?")))
        whole = re.compile("".join(f"({p.replace('#', number).replace('%', small)})" + ("?" if optional else "") for p, _, optional in parts))
        for letter in beginnings([(p, optional) for p, _, optional in parts]):
            out.setdefault(letter, []).append((whole, [LABELS.index(name) for _, name, _ in parts]))
    return out


def letters(tokens: list[str]) -> tuple[str, list[int]]:
    """The class letters of a text, with a bar where a clause begins or ends, and the token of each letter (-1 for bars)."""
    keys = [" " if t.isspace() else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower() for t in tokens]
    out, at = ["|"], [-1]
    i = 0
    while i < len(keys):
        node, j, found, stop = trie(), i, None, i
        while j < len(keys) and keys[j] in node:
            node, j = node[keys[j]], j + 1
            if None in node:
                found, stop = node[None], j
        word = keys[i]
        if found is None:
            stop = i + 1
            if word.isdigit():
                found = "d" if len(word) <= 2 else "D" if len(word) == 4 and word[0] in "12" else "#"
                found = "0" if found == "#" else found
            else:
                found = word if word in ",/-:." else "-" if word in "–—" else ";" if not word.isalpha() else "_"
        if word != " ":
            for k in range(i, stop):
                if keys[k] != " ":
                    out.append(found)
                    at.append(k)
            if word in ".,;!?" and not (stop < len(keys) and keys[stop].isdigit()):
                out.append("|")
                at.append(-1)
        i = stop
    return "".join(out) + "|", at + [-1]


def label(tokens: list[str]) -> tuple[list[int], list[bool]]:
    """A label and a mark of a clause's beginning for each token."""
    said, at = letters(tokens)
    labels, starts = [0] * len(tokens), [False] * len(tokens)
    by_letter, i = rules(), 0
    while i < len(said):
        best, given = None, []
        for pattern, names in by_letter.get(said[i], ()):
            m = pattern.match(said, i)
            if m and m.end() > i and (best is None or m.end() > best.end()):
                best, given = m, names
        if best is None:
            i += 1
            continue
        for k, name in enumerate(given, 1):
            for place in range(*best.span(k)):
                if at[place] >= 0:
                    labels[at[place]] = name
        i = best.end()
    opened = closing = False
    for k, name in enumerate(labels):  # "từ" opens a range, which the next "đến" ends
        if name == FROM:
            opened, closing = True, False
        elif name == UNTIL and opened:
            labels[k], closing = TO, True
        elif name and (closing or name == TO):
            opened = closing = False
    seen: set[int] = set()
    joined = False
    for k, name in enumerate(labels):
        if name == 31 or (not name and tokens[k] in (",", "và") and seen):
            joined = True
            ahead = [n for n in labels[k + 1 : k + 12] if n]
            again = bool(ahead) and (ahead[0] in DAYS and seen & CLOCKS and bool(seen & DAYS) or ahead[0] in CLOCKS and bool(seen & CLOCKS))
            if again and name == 0:
                labels[k] = 31
            joined = again
        elif name:
            if joined:
                starts[k], seen = True, set()
            joined = False
            seen.add(name)
    return labels, starts


def label_df(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    """Append the labelled tokens of a text column, as `operators.expressions` takes them; a column of that name is replaced.

    Starts and ends count the UTF-16 units of the text as given, also where its letters and marks come apart.
    """
    df = df.drop(name)
    kept, own = df.schema.fields, "_cut"
    while own in df.columns:
        own = "_" + own
    codes, marks = own + "_labels", own + "_starts"
    cut = df.withColumn(own, tx.tokens(tx.composed(F.col(text))))
    names = [f.name for f in kept] + [own, codes, marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if row is None else label(row) for row in batch.column(len(kept)).to_pylist()]
            given = [pa.array([f and f[0] for f in found], pa.list_(pa.int32())), pa.array([f and f[1] for f in found], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *given], names=names)

    added = [T.StructField(own, T.ArrayType(T.StringType())), T.StructField(codes, T.ArrayType(T.IntegerType())), T.StructField(marks, T.ArrayType(T.BooleanType()))]
    out = cut.mapInArrow(run, T.StructType(kept + added))

    def made(at: Column) -> Column:
        origin = F.when(F.col(text).rlike(f"[{tx.MARKS}]"), tx.sources(F.col(text)))

        def token(t: Column, i: Column, origin: Column) -> Column:
            given = lambda place: F.coalesce(F.get(origin, place), place)
            start, end = F.get(at, i), F.get(at, i) + tx.units(t)
            # a composed letter counts from its last mark; the word that it begins counts from the letter
            first = F.when(start == 0, 0).otherwise(given(start - 1) + 1)
            return F.struct(
                F.when(origin.isNull(), start).otherwise(first).alias("start"), given(end).alias("end"), t.alias("text"), tx.kind(t).alias("kind"), F.get(codes, i).alias("label"), F.get(marks, i).alias("clause_start"), F.lit(1.0).alias("score")
            )

        return tx.let(origin, lambda o: F.transform(own, lambda t, i: token(t, i, o)))

    return out.withColumn(name, F.when(F.col(own).isNotNull(), tx.let(tx.starts(F.col(own)), made))).drop(own, codes, marks)
