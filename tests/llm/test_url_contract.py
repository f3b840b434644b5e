"""The registered URL filter against the rules of its contract."""

from kairoframe.llm import registry

#: host, path, verdict
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_each_rule_of_the_contract_gives_its_own_verdict(spark, tmp_path):
    data = [(f"http://{prefix}{host}{path}{rest}", f"{host}{path}", verdict) for host, path, verdict in RULES for prefix in ("", "a.", "B.c.") for rest in ("", "1?q", "x#y")]
    rows = [(i, url) for i, (url, _, _) in enumerate(data)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in registry.op5_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(data)}
