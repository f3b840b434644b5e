"""Fixed values of the Vietnamese lexicon, and map expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number words, the units, days, parts of the day and modifiers that the grammar names.
NUMBERS = {
    "không": 0, "một": 1, "mốt": 1, "hai": 2, "đôi": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "nhăm": 5, "sáu": 6, "bảy": 7,
    "bẩy": 7, "tám": 8, "chín": 9, "mười": 10, "chục": 10, "nửa": 0.5, "rưỡi": 0.5, "vài": 3, "mấy": 3, "dăm": 3,
}
SCALES = {"mươi": 10, "trăm": 100, "nghìn": 1000, "ngàn": 1000}
UNITS = {
    "giây": "second", "phút": "minute", "giờ": "hour", "tiếng": "hour", "ngày": "day", "hôm": "day", "bữa": "day", "tuần": "week",
    "tháng": "month", "năm": "year", "h": "hour", "p": "minute", "ph": "minute",
}
RELATIVE_DAYS = {
    "hôm nay": 0, "nay": 0, "hnay": 0, "bữa nay": 0, "ngày hôm nay": 0, "ngày mai": 1, "mai": 1, "ngày kia": 2, "ngày mốt": 2, "mốt": 2,
    "kia": 2, "ngày kìa": 3, "hôm qua": -1, "hqua": -1, "qua": -1, "ngày hôm qua": -1, "hôm kia": -2, "hôm kìa": -3,
}
DAY_PARTS = {
    "sáng": "morning", "buổi sáng": "morning", "sáng sớm": "morning", "trưa": "noon", "buổi trưa": "noon", "chiều": "afternoon",
    "buổi chiều": "afternoon", "tối": "evening", "buổi tối": "evening", "đêm": "night", "ban đêm": "night", "buổi đêm": "night",
    "khuya": "night", "đêm khuya": "night",
}
MODIFIERS = {
    "này": "this", "nay": "this", "sau": "next", "sang": "next", "tới": "next", "kế": "next", "kế tiếp": "next", "sắp tới": "next",
    "tiếp theo": "next", "trước": "last", "trc": "last", "rồi": "last", "qua": "last", "ngoái": "last", "vừa rồi": "last", "vừa qua": "last",
}
WEEKDAYS = {
    "thứ hai": 0, "thứ 2": 0, "t2": 0, "thứ ba": 1, "thứ 3": 1, "t3": 1, "thứ tư": 2, "thứ bốn": 2, "thứ 4": 2, "t4": 2, "thứ năm": 3,
    "thứ 5": 3, "t5": 3, "thứ sáu": 4, "thứ 6": 4, "t6": 4, "thứ bảy": 5, "thứ bẩy": 5, "thứ 7": 5, "t7": 5, "thứ tám": 6, "thứ 8": 6,
    "chủ nhật": 6, "chúa nhật": 6, "chủ nhựt": 6, "cn": 6,
}
STEMS = "giáp ất bính đinh mậu kỷ canh tân nhâm quý".split()
BRANCHES = "tý sửu dần mão thìn tỵ ngọ mùi thân dậu tuất hợi".split()


# Months by name, edges, groups of days, clock names and office hours.
MONTHS = {
    "giêng": 1, "một": 1, "hai": 2, "ba": 3, "tư": 4, "bốn": 4, "năm": 5, "sáu": 6, "bảy": 7, "bẩy": 7, "tám": 8, "chín": 9, "mười": 10,
    "mười một": 11, "mười hai": 12, "chạp": 12,
} | {f"{m}": m for m in range(1, 13)}
NOW_WORDS = ["bây giờ", "bây h", "hiện tại", "ngay bây giờ", "hiện giờ", "lúc này", "ngay", "giờ"]
EDGES = {"đầu": "start", "đầu tiên": "start", "cuối": "end", "cuối cùng": "end", "giữa": "middle"}
DAY_GROUPS = {
    "cuối tuần": "weekend", "weekend": "weekend", "ngày thường": "weekday", "ngày làm việc": "weekday", "ngày trong tuần": "weekday",
    "ngày đi làm": "weekday",
}
NAMED_TIMES = {"nửa đêm": 0, "giữa đêm": 0, "giữa trưa": 12, "đúng trưa": 12}
NAMED_WINDOWS = {
    "giờ hành chính": (8, 17), "giờ làm việc": (8, 17), "giờ nghỉ trưa": (12, 13), "đầu giờ": (8, None), "đầu giờ sáng": (8, None),
    "cuối giờ sáng": (11, None), "đầu giờ chiều": (13, None), "cuối giờ": (17, None), "cuối giờ chiều": (17, None), "cuối giờ làm": (17, None),
    "hết giờ làm": (17, None),
} | {f"giờ {b}": ((23 + 2 * i) % 24, (1 + 2 * i) % 24) for i, b in enumerate(BRANCHES)}
NAMED_STARTS = {name: start for name, (start, _) in NAMED_WINDOWS.items()}
NAMED_ENDS = {name: end for name, (_, end) in NAMED_WINDOWS.items() if end is not None}
#: Other spellings of three branches.
BRANCH_VARIANTS = {"tí": "tý", "mẹo": "mão", "tị": "tỵ"}
# Holidays by their names; month and day by the solar or the lunar calendar.
HOLIDAYS = {
    "new-year": ["tết dương lịch", "tết tây", "năm mới", "tết dương"], "valentines": ["valentine", "valentines", "lễ tình nhân", "tình nhân"],
    "womens-day": ["quốc tế phụ nữ"], "liberation-day": ["giải phóng miền nam", "giải phóng"], "labour-day": ["quốc tế lao động", "lao động"],
    "childrens-day": ["quốc tế thiếu nhi", "thiếu nhi"], "national-day": ["quốc khánh"], "vn-womens-day": ["phụ nữ việt nam"],
    "teachers-day": ["nhà giáo việt nam", "nhà giáo"], "christmas": ["giáng sinh", "noel", "nô en"],
    "christmas-eve": ["đêm giáng sinh", "đêm noel"], "new-years-eve": ["giao thừa tây", "giao thừa dương lịch"],
    "tet": ["tết", "tết nguyên đán", "tết âm lịch", "tết ta", "tết cổ truyền", "tết âm", "nguyên đán"], "tet-eve": ["giao thừa", "đêm giao thừa"],
    "lantern-festival": ["tết nguyên tiêu", "nguyên tiêu"], "hung-kings": ["giỗ tổ", "giỗ tổ hùng vương", "hùng vương"],
    "doan-ngo": ["tết đoan ngọ", "đoan ngọ"], "vu-lan": ["vu lan", "lễ vu lan"], "mid-autumn": ["trung thu", "tết trung thu", "rằm trung thu"],
    "kitchen-gods": ["ông táo", "tết ông táo", "ông công ông táo", "táo quân"],
}
SOLAR_HOLIDAYS = {
    "new-year": (1, 1), "valentines": (2, 14), "womens-day": (3, 8), "liberation-day": (4, 30), "labour-day": (5, 1), "childrens-day": (6, 1),
    "national-day": (9, 2), "vn-womens-day": (10, 20), "teachers-day": (11, 20), "christmas": (12, 25), "christmas-eve": (12, 24),
    "new-years-eve": (12, 31),
}
LUNAR_HOLIDAYS = {
    "tet": (1, 1), "lantern-festival": (1, 15), "hung-kings": (3, 10), "doan-ngo": (5, 5), "vu-lan": (7, 15), "mid-autumn": (8, 15),
    "kitchen-gods": (12, 23),
}
HOLIDAY_OF = {alias: name for name, aliases in HOLIDAYS.items() for alias in aliases}


#: Words of the lunar calendar, and further ones that a text about time has.
LUNAR_WORDS = ["âm lịch", "âm", "âl", "lịch âm", "lịch ta", "mùng", "mồng", "rằm", "nhuận"]
TIME_CUES = ["thứ", "cn", "hàng", "hằng", "mỗi", "tết", "lịch", "am", "pm", "hôm", "hẹn", "lúc"]
TIME_PHRASES = sorted({*UNITS, *DAY_PARTS, *RELATIVE_DAYS, *DAY_GROUPS, *HOLIDAY_OF, *NAMED_TIMES, *NAMED_WINDOWS, *NOW_WORDS, *LUNAR_WORDS, *TIME_CUES, *WEEKDAYS})


def mentions_time(word_key: Column) -> Column:
    """Has a key a number, or words in a row that are a phrase of the lexicon?"""
    words = F.filter(F.split(word_key, r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def some(ws: Column) -> Column:
        out = F.exists(ws, lambda w: w.rlike("[0-9]"))
        for n in range(1, max(len(p.split()) for p in TIME_PHRASES) + 1):
            known = F.array(*[F.lit(p) for p in TIME_PHRASES if len(p.split()) == n])
            out = out | F.arrays_overlap(ngrams(ws, n), known)
        return out

    def ngrams(ws: Column, n: int) -> Column:
        return F.transform(ws, lambda w, i: F.array_join(F.slice(ws, i + 1, n), " ")) if n > 1 else ws

    return F.get(F.transform(F.array(words), some), F.lit(0))


def lookup(table: dict, word: Column) -> Column:
    """The value of a word that is a key already (`text.key`), null where the table has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word)


def alternatives(table: dict) -> str:
    """A pattern for any of a table's words, longest first."""
    return "|".join(sorted(table, key=lambda w: (-len(w), w)))


def sexagenary_name(cycle: Column) -> Column:
    """The name of a place in the cycle of sixty, from 0."""
    words = lambda w: F.array(*[F.lit(x) for x in w])
    return F.concat_ws(" ", F.get(words(STEMS), F.pmod(cycle, F.lit(10))), F.get(words(BRANCHES), F.pmod(cycle, F.lit(12))))


def sexagenary(stem: Column, branch: Column) -> Column:
    """A pair's place in the cycle of sixty, from 0; null for a pair that the cycle lacks."""
    s = lookup({w: i for i, w in enumerate(STEMS)}, stem)
    places = {w: i for i, w in enumerate(BRANCHES)}
    b = lookup(places | {v: places[w] for v, w in BRANCH_VARIANTS.items()}, branch)
    return F.when(F.pmod(s - b, F.lit(2)) == 0, F.pmod(36 * s + 25 * b, F.lit(60)))
