"""Labelled tokens, features, quantities, policies and rules on small cases."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kairoframe.functions import civil, features, lexicon, numerals, text
from kairoframe.operators import dates, evaluation, expressions, islands, recurrence
from kairoframe.sources import files

O, NUM, UNIT, MONTH, DOM, YEAR, HOUR, JOIN, GLUE = 0, 1, 3, 11, 12, 13, 14, 31, 32


def labelled(parts, mark=()):
    """Tokens of words with labels, spaces between them; a word with a leading "^" follows without a space."""
    out, at = [], 0
    for n, (word, label) in enumerate(parts):
        if word.startswith("^"):
            word = word[1:]
        elif out:
            out.append((at, at + 1, " ", 3, 0, False, 1.0))
            at += 1
        kind = 1 if word.isdigit() else 0 if word[0].isalpha() else 2
        out.append((at, at + len(word), word, kind, label, n in mark, 1.0 - n / 100))
        at += len(word)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, ts array<{expressions.TOKEN}>")


def words(tokens):
    return [t["text"] for t in tokens]


def test_expressions_are_cut_at_long_asides_and_trimmed(spark):
    cases = [
        ([("hẹn", O), ("8", HOUR), ("giờ", GLUE), ("tối", 19)], [["8", "giờ", "tối"]]),
        ([("8", HOUR), ("a", O), ("b", O), ("c", O), ("mai", 7)], [["8", "a", "b", "c", "mai"]]),
        ([("8", HOUR), ("a", O), ("b", O), ("c", O), ("d", O), ("mai", 7), ("z", O)], [["8"], ["mai"]]),
        ([("tầm", O), ("2", NUM), ("tiếng", UNIT), ("nữa", 5)], [["tầm", "2", "tiếng", "nữa"]]),
        ([("tầm", O), ("mai", 7)], [["mai"]]),
        ([("và", JOIN), ("mai", 7), (",", O), ("và", JOIN)], [["mai"]]),
        ([("mai", 7), ("lúc", GLUE)], [["mai"]]),
        ([("8", HOUR), ("^giờ", GLUE)], [["8", "giờ"]]),
        ([("và", JOIN), ("lúc", O)], []),
        ([("a", O), ("b", O)], []),
        ([], []),
    ]
    rows = frame(spark, [labelled(c) for c, _ in cases] + [None])
    got = {r[0]: r[1] for r in rows.select("i", expressions.split_expressions(F.col("ts"))).collect()}
    assert [[words(e) for e in got[i]] for i in range(len(cases))] == [w for _, w in cases] and got[len(cases)] is None


def naive_expressions(tokens):
    """By the definition: a state machine over the tokens that aren't spaces."""
    skipped = {O, JOIN, GLUE}
    out, current, aside, leading = [], [], [], []
    for t in (t for t in tokens if t[3] != 3):
        filler, label = t[2].lower() in expressions.FILLER, t[4]
        if not current and label == O:
            leading.append(t)
        elif label != O or filler:
            if not current and label == NUM and leading and leading[-1][2] in expressions.APPROXIMATE:
                current.append(leading[-1])
            leading = []
            if len(aside) > 3:
                out.append(current)
                current = []
            else:
                current += aside
            aside = []
            current.append(t)
        else:
            aside.append(t)
    out += [current] if current else []
    kept = []
    for e in out:
        while e and e[0][4] in skipped and not (e[0][2] in expressions.APPROXIMATE and len(e) > 1 and e[1][4] == NUM):
            e = e[1:]
        while e and (e[-1][4] in skipped if e[-1][4] != GLUE else e[-1][2].lower() in expressions.FILLER):
            e = e[:-1]
        kept += [e] if e else []
    return kept


def naive_clauses(tokens):
    out = [[]]
    for t in tokens:
        if t[5] and any(x[4] not in (O, JOIN, GLUE) for x in out[-1]):
            out.append([])
        out[-1].append(t)
    return out


def naive_segments(tokens):
    out = []
    for t in tokens:
        last = out[-1][-1] if out else None
        if last and last[4] == t[4] and not (t[3] == 1 and last[3] == 1) and t[4] not in (O, JOIN, GLUE):
            out[-1].append(t)
        else:
            out.append([t])
    return out


def test_expressions_clauses_and_segments_of_random_tokens(spark):
    rng = random.Random(2)
    vocabulary = ["tầm", "và", ",", "lúc", "x", "y", "15", "3", "giờ"]
    given = []
    for _ in range(150):
        parts = [(rng.choice(["", "^"]) + rng.choice(vocabulary), rng.choice([O, O, O, O, NUM, JOIN, GLUE, DOM])) for _ in range(rng.randrange(25))]
        given.append(labelled(parts, {i for i in range(25) if rng.random() < 0.3}))
    rows = frame(spark, given).select("i", F.posexplode(expressions.split_expressions(F.col("ts"))).alias("n", "e"))
    rows = rows.select("i", "n", "e", expressions.split_clauses(F.col("e")).alias("c"), expressions.segments(F.col("e")).alias("s"))
    got = {(r["i"], r["n"]): r for r in rows.collect()}
    wanted = {(i, n): e for i, ts in enumerate(given) for n, e in enumerate(naive_expressions(ts))}
    assert set(got) == set(wanted)
    plain = lambda ts: [tuple(t) for t in ts]
    for place, e in wanted.items():
        assert plain(got[place]["e"]) == e
        assert [plain(c) for c in got[place]["c"]] == naive_clauses(e)
        assert [plain(s["tokens"]) for s in got[place]["s"]] == naive_segments(e)


def test_segments_read_as_their_source(spark):
    rows = frame(spark, [labelled([("Hai", NUM), ("mươi", NUM), ("15", DOM), ("3", DOM), ("âm", 35), ("^lịch", 35)])])
    found = rows.select(expressions.segments(F.col("ts")).alias("s")).head()["s"]
    assert [(s["role"], s["text"]) for s in found] == [(NUM, "hai mươi"), (DOM, "15"), (DOM, "3"), (35, "âmlịch")]


@pytest.mark.parametrize(
    "parts,order,labels",
    [
        ([("10", DOM), ("/", GLUE), ("3", DOM)], "DMY", [DOM, MONTH]),
        ([("10", DOM), ("/", GLUE), ("3", DOM)], "MDY", [MONTH, DOM]),
        ([("3", DOM), ("/", GLUE), ("25", MONTH)], "DMY", [MONTH, DOM]),
        ([("25", MONTH), ("-", O), ("3", DOM)], "MDY", [DOM, MONTH]),
        ([("2026", YEAR), ("-", GLUE), ("9", DOM), ("-", GLUE), ("7", DOM)], "DMY", [MONTH, DOM]),
        ([("13", DOM), (".", GLUE), ("14", MONTH)], "DMY", [DOM, MONTH]),
        ([("10", DOM), ("x", GLUE), ("3", MONTH)], "MDY", [DOM, MONTH]),
        ([("40", MONTH), ("/", GLUE), ("3", DOM)], "DMY", [MONTH, DOM]),
    ],
)
def test_numeric_dates_are_ordered(spark, parts, order, labels):
    tokens = [t for t in labelled(parts) if t[3] != 3]
    out = frame(spark, [tokens]).select(expressions.date_order(F.col("ts"), order).alias("t")).head()["t"]
    assert [t["label"] for t in out if t["text"].isdigit() and len(t["text"]) < 3] == labels


def test_summaries_and_shared_rules(spark):
    rows = frame(spark, [labelled([("8", HOUR), ("ồn", O), ("tối", 19), ("ào", O), ("mai", 7)])])
    s = rows.select(expressions.summary(F.col("ts"), F.lit("8 ồn tối ào mai")).alias("s")).select("s.*").head()
    late = frame(spark, [[(t[0] + 3, t[1] + 3, *t[2:]) for t in labelled([("8", HOUR), ("mai", 7)])]]).select(expressions.summary(F.col("ts"), F.lit("🎉 8 mai")).alias("s")).head()
    assert late["s"]["text"] == "8 mai"
    assert (s["start"], s["end"], s["text"], s["ignored"], s["unsure"]) == (0, 15, "8 ồn tối ào mai", "ồn ào", False) and s["confidence"] == pytest.approx(0.96)
    schema = "cs array<struct<recurrence:string,date:string,shift:string,time:string>>"
    given = [[("r", None, None, "8"), (None, None, None, "9"), (None, "d", None, "9")], [("r", None, None, None), ("q", None, None, None), (None, None, None, "9")], [("r", None, None, "8")]]
    got = spark.createDataFrame([(g,) for g in given], schema).select(expressions.share_recurrence(F.col("cs"))).collect()
    assert [[c["recurrence"] for c in r[0]] for r in got] == [["r", "r", None], ["r", "q", None], ["r"]]


def test_classes_of_characters_and_signs(spark):
    cases = {"a": 0, "Z": 25, "ế": 29, "Đ": 28, "á": 0, "ư": 32, "7": 40, ":": 43, "`": 50, "?": 56, "ü": 43, "ñ": 13}
    rows = spark.createDataFrame(list(cases.items()), "c string, n int").select("c", "n", features.character_class(F.col("c")).alias("k")).collect()
    assert {r["c"]: r["k"] for r in rows} == cases
    signs = spark.createDataFrame([(":", 1), ("—", 2), ("@", 11), ("?", 12), ("ab", 0), (" ", 0), (None, 0), ("::", 0)], "t string, n int")
    assert all(r[0] == r[1] for r in signs.select("n", features.punctuation_class(F.col("t"))).collect())
    assert spark.range(1).select(features.skeleton(F.lit("Đường")), features.base_letter(F.lit("Ế"))).head()[:] == ("đng", "ê")


def test_feature_rows_lie_in_their_regions(spark):
    rows = spark.createDataFrame([("Thứ hai 15h, rồi 🎉",)], "t string").select(F.explode(features.between(text.tokens(F.col("t")))).alias("x")).select("x.*")
    got = rows.select("t", features.feature_rows(features.features(F.col("t"), F.col("before"), F.col("after"))).alias("r")).collect()
    assert all(9 <= len(r["r"]) <= 17 and max(r["r"]) < features.ROWS and len(set(r["r"])) == len(r["r"]) for r in got)
    suffix = next(r["r"] for r in got if r["t"] == "h")
    assert 524 + 7 in suffix and 524 + 3 in got[0]["r"] and 524 + 4 in got[-1]["r"]


def test_windows_say_where_they_begin_and_end(spark):
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.struct(i.alias("i"), F.lit(3072).cast("long").alias("context"))).alias("ts"))
    got = rows.select(F.explode(islands.slices(F.col("ts"))).alias("w")).select("w.*").collect()
    assert [(w["keep_start"], w["keep_end"], w["tokens"][0]["i"], w["tokens"][-1]["i"]) for w in got] == [(0, 96, 0, 111), (96, 192, 80, 199), (192, 200, 176, 199)]
    assert all([t["context"] for t in w["tokens"]] == [1024, *[0] * (len(w["tokens"]) - 2), 2048] for w in got)


def test_times_are_mentioned(spark):
    cases = {"tôi đi làm": False, "ngày đi làm": True, "có 3 cái": True, "gặp lúc nào": True, "xin chào bạn": False, "T2": True, "": False, "quốc khánh": True}
    rows = spark.createDataFrame(list(cases.items()), "t string, b boolean").select("t", lexicon.mentions_time(text.key(F.col("t"))).alias("m")).collect()
    assert {r["t"]: r["m"] for r in rows} == cases


def test_durations(spark):
    cases = {
        "1 tiếng 30 phút": [(1, "hour"), (30, "minute")], "hai tiếng rưỡi": [(2.5, "hour")], "1,5 giờ": [(1.5, "hour")], "nửa tháng": [(15, "day")], "nửa ngày": [(12, "hour")],
        "nửa năm": [(6, "month")], "2 quý": [(6, "month")], "1,5 tháng": None, "tuần": None, "hai mươi mốt ngày": [(21, "day")], "3 ngày xin chào": None, "0 ngày": None, "": None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", numerals.durations(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] and [tuple(x) for x in r["d"]] for r in rows} == cases


def test_policies_and_contexts(spark):
    day = F.lit(date(2026, 9, 17))  # a Thursday
    near = lambda w, m, **p: spark.range(1).select(civil.weekday_near(day, F.lit(w), F.lit(m).cast("string"), **p)).head()[0]
    assert near(0, None, bare="nearest") == date(2026, 9, 14) and near(6, "this", first="SU") == date(2026, 9, 13) and near(0, "next", distance=2) == date(2026, 9, 28)
    assert near(3, "next", following="immediate") == date(2026, 9, 24) and near(0, "next") == date(2026, 9, 21)
    with pytest.raises(ValueError):
        near(0, None, bare="other")
    dates.checked_context("Asia/Ho_Chi_Minh", 1000)
    for zone, limit in (("Mars/Olympus", 1), ("UTC", 0), ("UTC", 1001)):
        with pytest.raises(ValueError):
            dates.checked_context(zone, limit)
    row = spark.range(1).select(
        civil.instant(F.lit("2026-09-17T09:00:00+07:00")).cast("timestamp_ntz"), civil.instant(F.lit("2026-09-17T09:00:00")), civil.instant(F.lit("2026-02-30T09:00:00Z")),
        civil.inherited_part(F.lit(7), F.lit(None).cast("string"), F.lit(9), F.lit("evening")), civil.inherited_part(F.lit(10), F.lit(None).cast("string"), F.lit(9), F.lit("evening")),
        dates.weekly_if_bare(F.array(F.lit(3), F.lit(1)), F.lit(None).cast("string"), "weekly"), dates.weekly_if_bare(F.array(F.lit(3)), F.lit("next"), "weekly"),
    ).head()
    assert row[:] == (datetime(2026, 9, 17, 2), None, None, "evening", None, [1, 3], None)


def test_lunar_ranges(spark):
    days = dates.lunar_days(spark, 2025, 2027)
    assert [tuple(r) for r in dates.lunar_range(days, 2026, 1, 1, 3).collect()] == [(date(2026, 2, 17), date(2026, 2, 20))]
    assert dates.lunar_range(days, 2026, 1, 31, 40).count() == 0


def test_counts_skip_exclusions(spark):
    first = F.lit(date(2026, 1, 5))
    mondays = recurrence.weekly(first, F.lit(date(2026, 12, 31)), [0])
    got = spark.range(1).select(recurrence.counted(mondays, lambda d: recurrence.is_ordinal(d, 0, -1), 4, F.lit(date(2026, 1, 13)))).head()[0]
    assert got == [date(2026, 1, 19), date(2026, 2, 2)]
    assert recurrence.excluded_weekdays(5, 1) == [5, 6, 0, 1] and recurrence.times_per_week(3, "SU") == [6, 1, 3] and recurrence.times_per_day(3) == [0, 8, 16]
    with pytest.raises(ValueError):
        recurrence.times_per_day(25)


def test_thresholds_and_support(spark):
    rows = spark.createDataFrame([(0.0, "a", 0.5), (0.0, "b", 0.9), (1.0, "a", 0.7), (1.0, "b", 0.6)], "t double, g string, f double")
    assert evaluation.best_threshold(rows, "t", "f", "g").head()[:] == (1.0, 0.6)
    few = spark.createDataFrame([(0, 6)], "f int, b int").select(evaluation.regressed(F.col("f"), F.col("b")), evaluation.regressed(F.col("f"), F.col("b"), support=10))
    assert few.head()[:] == (True, False)


def test_readers_and_the_manifest(spark, tmp_path):
    import bz2

    (tmp_path / "gold.jsonl").write_text('{"text": "mai", "n": 1}\nnot json\n{"text": "nay"}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "gold.jsonl"), "text string, n int")
    assert {tuple(r) for r in rows.collect()} == {("mai", 1), (None, None), ("nay", None)}
    (tmp_path / "s.tsv.bz2").write_bytes(bz2.compress('1\tvie\tMột "câu\n2\teng\tA sentence\n'.encode()))
    assert [tuple(r) for r in files.read_sentences(spark, str(tmp_path / "s.tsv.bz2"), "vie").collect()] == [(1, "vie", 'Một "câu')]
    out = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "text string, family string")
    manifest = files.write_corpus(out, str(tmp_path / "corpus"), "family")
    told = files.write_corpus(out.withColumn("sign", F.lit("s")), str(tmp_path / "signed"), "family", "sign")
    assert {r["family"]: (r["count"], r["signatures"]) for r in told.collect()} == {"x": (2, 1), "y": (1, 1)}
    shards = spark.createDataFrame([(1, 32), (2, 64), (3, 128)], "n int, bucket int")
    files.append_features(shards, str(tmp_path / "shards"))
    files.append_features(shards.limit(1), str(tmp_path / "shards"))
    read = files.scan_features(spark, str(tmp_path / "shards"), 64)
    assert sorted(r["n"] for r in read.collect()) == [1, 1, 2]
    assert {r["family"]: r["count"] for r in manifest.collect()} == {"x": 2, "y": 1} and spark.read.json(str(tmp_path / "corpus")).count() == 3


def test_phrases_over_a_stream(spark, tmp_path):
    from kairoframe.streaming.parse import parse_stream

    rows = spark.createDataFrame([("ngày mai",), ("25h",)], "text string").withColumn("ref", F.lit("2026-09-17 09:00:00").cast("timestamp_ntz"))
    rows.write.parquet(str(tmp_path / "in"))
    run = parse_stream(spark, str(tmp_path / "in"), "text string, ref timestamp_ntz", "ref").writeStream.format("memory").queryName("parsed").trigger(availableNow=True).start()
    run.awaitTermination(60)
    found = {r["text"]: (r["start"], r["diagnostic"]) for r in spark.table("parsed").collect()}
    assert found == {"ngày mai": (datetime(2026, 9, 18), None), "25h": (None, "invalid-time")}


def test_scores_of_all_thresholds_at_once(spark):
    data = [("a", i % 3 == 0, float(i % 7)) for i in range(50)] + [("b", True, None), ("b", False, 2.0), ("b", None, 3.0)]
    rows = spark.createDataFrame(data, "g string, t boolean, v double")
    for r in evaluation.threshold_scores(rows, F.col("t"), F.col("v"), [4.0, 0.0, 2.5], [F.col("g")]).collect():
        mine = [(t, v is not None and v > r["threshold"]) for g, t, v in data if g == r["g"] and t is not None]
        tp, fp, fn = sum(t and p for t, p in mine), sum(not t and p for t, p in mine), sum(t and not p for t, p in mine)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn) and r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert evaluation.threshold_scores(rows.limit(0), F.col("t"), F.col("v"), [1.0], [F.col("g")]).count() == 0
