"""Work on distinct texts: each once, whatever the rows."""

from pyspark.sql import functions as F

from kairoframe.plans import catalog, catalog_said, catalog_tokens


def orders(spark, tmp_path, step):
    """Three hundred orders of one customer and day, and one without a day."""
    rows = spark.sql(f"select id * {step} o_orderkey, 5L o_custkey, if(id < 300, timestamp_ntz'2026-03-04 00:00:00', null) o_orderdate from range(301)")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_nulls_and_repeated_rows_come_back(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (2, "a", None), (3, None, 1), (4, None, None), (5, "b", 1)], "i int, k string, m int")
    given = []

    def work(keys):
        given.append(sorted(map(str, keys.collect())))
        return keys.where("k is null or k <> 'b'").withColumn("x", F.concat_ws("-", F.lit("x"), "k", "m"))

    for few in (False, True):
        got = sorted((r.i, r.k or "", r.m or 0, r.x) for r in catalog.once(df, ["k", "m"], work, few).collect())
        assert got == [(1, "a", 0, "x-a"), (2, "a", 0, "x-a"), (2, "a", 0, "x-a"), (3, "", 1, "x-1"), (4, "", 0, "x")]
    assert [len(g) for g in given] == [4, 4]


def counted(monkeypatch):
    seen, plain = [], catalog_said.labels.label_df
    monkeypatch.setattr(catalog_said.labels, "label_df", lambda df, text: (seen.append(df.count()), plain(df, text))[1])
    return seen


def test_a_text_is_compiled_once(spark, tmp_path, monkeypatch):
    seen = counted(monkeypatch)
    got = catalog_said.compiled_clauses(spark, orders(spark, tmp_path, 7)).collect()
    assert seen == [2]
    assert len(got) == 301 and {(r.day, r.month, r.year, r.hour, r.minute) for r in got if r.o_orderkey < 2100} == {(4, 3, 2026, 18, 15)}


def test_a_text_of_a_day_is_resolved_once(spark, tmp_path, monkeypatch):
    seen = counted(monkeypatch)
    got = catalog_said.resolved_clauses(spark, orders(spark, tmp_path, 10)).where("start is not null").collect()
    assert seen == [1]
    assert len(got) == 300 and {(r.seq, str(r.start)) for r in got} == {(0, "2026-03-05 20:00:00")}


def test_a_number_is_said_and_read_once(spark, tmp_path, monkeypatch):
    seen = []
    rows = spark.range(0, 99 * 50, 99).withColumnRenamed("id", "o_orderkey")
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(catalog_tokens, "read_durations", lambda df, real=catalog_tokens.read_durations: (seen.append(df.count()), real(df))[1])
    assert catalog_tokens.spelled_durations(spark, str(tmp_path)).count() == 250 and seen == [1]
