"""The operators' queries over the driver's tables, and their SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact, langid, lines, mixing, packing, quality, simhash, urls, vectors, warc, whitening
from .common import small_batches

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
RANKS = "byte_bpe_50k.tiktoken"
KEEP = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder(4) == 2
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    model = quality.learn(docs, labels)
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with exact.new_index(spark) as index:
        found = exact.assign(docs, index, exact.halves(docs))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def captures(pages: DataFrame) -> DataFrame:
    """Archive records made of pages: each a full response, and a revisit half an hour to a day later.

    Every tenth revisit has an entity tag of its own, and every tenth a date in place of a tag. Of
    every tenth page the response comes twice, of every tenth the revisit; and every tenth revisit has
    the record id of the one before. Pages without an id make no records.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 8), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 7).cast("string"))
    at = F.lit(1_700_000_000) + F.col("page_id") * 60
    kind = F.col("page_id") % 10
    shared = F.when(kind == 5, F.col("page_id") - 1).otherwise(F.col("page_id"))
    more = [F.lit("Content-Type"), F.lit("text/plain"), F.lit("Cache-Control"), F.lit("max-age=90")]
    first = F.struct(
        F.col("page_id").alias("record_id"), F.col("url").alias("uri"), at.alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
        F.col("html").alias("body"),
    )
    again = F.struct(
        (-shared - 1).alias("record_id"), F.col("url").alias("uri"), (at + 1800 * (1 + F.col("page_id") % 48)).alias("ts"), F.lit(304).alias("status"),
        F.when(kind == 1, F.create_map(F.lit("last-modified"), date, *more)).when(kind == 0, F.create_map(F.lit("etag"), F.lit('"gone"'), *more))
        .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), *more)).alias("headers"),
        F.lit(None).cast("string").alias("body"),
    )
    records = F.when(kind == 2, F.array(first, first, again)).when(kind == 3, F.array(first, again, again)).otherwise(F.array(first, again))
    return pages.where("page_id is not null").select(F.explode(records).alias("r")).select("r.*")


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    return found.select((-F.col("record_id") - 1).alias("page_id"), "url", "ts", "source_id", "outcome", shown.alias("headers"), F.md5("body").alias("body_md5"))


OP6_SQL = r"""
WITH raw AS (
  SELECT page_id, html, 1700000000 + page_id * 60 AS t0, '"' || substr(md5(html), 1, 8) || '"' AS tag, 'day ' || (page_id % 7) AS dat,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://(www[.])?', '', 'i') AS bare FROM pages WHERE page_id IS NOT NULL),
parts AS (SELECT *, lower(regexp_extract(bare, '^[^/?]*')) AS host, substr(bare, length(regexp_extract(bare, '^[^/?]*')) + 1) AS rest FROM raw),
full_ AS (SELECT *, regexp_replace(host, ':(80|443)$', '') || regexp_replace(regexp_replace(regexp_replace(rest, '([?&])utm_[a-z]+=[^&]*&', '\1', 'g'),
    '[?&]utm_[a-z]+=[^&]*$', ''), '/$', '') AS url FROM parts),
revisit AS (SELECT row_number() OVER () AS n, CASE WHEN page_id % 10 = 5 THEN page_id - 1 ELSE page_id END AS page_id, url, t0 + 1800 * (1 + page_id % 48) AS ts, CASE WHEN page_id % 10 = 1 THEN NULL WHEN page_id % 10 = 0 THEN '"gone"' ELSE tag END AS etag,
    CASE WHEN page_id % 10 = 1 THEN dat END AS dat, tag AS own FROM full_, (VALUES (1), (2)) twice(k) WHERE k = 1 OR page_id % 10 = 3),
joined AS (SELECT r.n, r.page_id, r.url, r.ts, r.etag, r.dat, max({'t0': f.t0, 'id': f.page_id}) AS m FROM revisit r LEFT JOIN full_ f ON f.url = r.url AND f.t0 < r.ts GROUP BY ALL),
told AS (SELECT j.*, f.page_id AS source_id, f.tag AS stag, f.dat AS sdat, f.html,
    CASE WHEN f.page_id IS NULL THEN 'unmatched' WHEN j.etag IS NOT NULL THEN CASE WHEN j.etag = f.tag THEN 'resolved' ELSE 'mismatch' END
      WHEN j.dat = f.dat THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM joined j LEFT JOIN full_ f ON f.page_id = j.m.id)
SELECT page_id, url, ts, source_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=90' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || CASE WHEN etag IS NULL THEN stag ELSE 'W/' || etag END || chr(10) || 'last-modified: ' || sdat
    ELSE 'cache-control: max-age=90' || chr(10) || 'content-type: text/plain' || chr(10) || CASE WHEN etag IS NULL THEN 'last-modified: ' || dat WHEN etag = '"gone"' THEN 'etag: "gone"' ELSE 'etag: W/' || etag END END AS headers,
  CASE WHEN outcome = 'resolved' THEN md5(html) END AS body_md5
FROM told
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(3) == 1, F.lit(False))
    found = langid.identify(docs.drop("lang"), langid.learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = r"""
WITH split AS (SELECT doc_id, md5(text) AS own, row_number() OVER () AS row, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT row, doc_id, own, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM split),
bare AS (SELECT row, doc_id, own, pos, trim(l, ' ' || chr(9) || chr(13)) AS l FROM line),
win AS (SELECT doc_id, own, pos, l || chr(10) || lead(l, 1) OVER w || chr(10) || lead(l, 2) OVER w AS passage FROM bare WINDOW w AS (PARTITION BY row ORDER BY pos)),
good AS (SELECT doc_id, own, pos, md5(passage) AS h FROM win WHERE passage IS NOT NULL AND length(passage) > 2 AND doc_id IS NOT NULL),
firsts AS (SELECT h, min({'d': doc_id, 'o': own, 'p': pos}) AS f FROM good GROUP BY h HAVING count(*) > 1),
later AS (SELECT g.doc_id, g.own, CASE WHEN g.doc_id = f.d AND g.own = f.o THEN greatest(g.pos, f.p + 3) ELSE g.pos END AS b, g.pos + 2 AS e
  FROM good g JOIN firsts USING (h) WHERE g.doc_id <> f.d OR g.own <> f.o OR g.pos <> f.p),
gone AS (SELECT DISTINCT doc_id, own, unnest(range(b, e + 1)) AS pos FROM later WHERE b <= e),
kept AS (SELECT line.row, string_agg(l, chr(10) ORDER BY pos) AS t FROM line ANTI JOIN gone USING (doc_id, own, pos) GROUP BY line.row),
lost AS (SELECT doc_id, own, count(*) AS n FROM gone GROUP BY ALL)
SELECT s.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, CASE WHEN ls IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256
FROM split s LEFT JOIN kept USING (row) LEFT JOIN lost ON lost.doc_id = s.doc_id AND lost.own = s.own
"""


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.components(table(spark, sf_dir, "embeddings"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks).drop("text"), ranks)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, size = table(spark, sf_dir, "documents").select("text", "lang"), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "4m")  # a shard is a row of up to some MB; all that goes through Python has run when `mine` returns
    try:
        return collocations.mine(docs)
    finally:
        spark.conf.set(size, before)


OP11_SQL = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
cut AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM cut, range(1, 6) sizes(m) WHERE len(w) >= m),
f AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
inner_ AS (SELECT lang, f, m, unnest(list_transform(range(2, m), lambda size: list_transform(range(1, m - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' ')))) AS inside FROM parts WHERE m > 2),
gone AS (SELECT DISTINCT f.lang, f.phrase FROM (SELECT lang, f, unnest(inside) AS phrase FROM inner_) longer JOIN f USING (lang, phrase) WHERE 100 * longer.f >= 100 * f.f),
cuts AS (SELECT lang, phrase, f AS a, w, m, unnest(range(1, m)) AS k FROM parts ANTI JOIN gone USING (lang, phrase)),
scored AS (SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, n, ((1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:k], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1:c.m], ' ') JOIN total ON total.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH doc AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS drawn FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM doc GROUP BY source),
weighed AS (SELECT *, [1, 2, 3][(place - 1) % 3 + 1] AS weight, sum(source_size) OVER ()::BIGINT AS total FROM by_source),
ratio AS (SELECT *, 3 * source_size / weight AS ratio FROM weighed),
filled AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ratio WINDOW w AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT *, least((3 * source_size)::DOUBLE, (max(level) FILTER (ratio >= level) OVER ()) * weight) AS target FROM filled),
sized AS (SELECT *, greatest(1, least(1024, coalesce(floor(min(target) FILTER (target > 0) OVER () / 256), 1)))::BIGINT AS block FROM goal),
seated AS (SELECT *, round(total / block)::BIGINT AS seats, greatest(1, ceil(source_size / 4194304))::BIGINT AS shards FROM sized),
offered AS (SELECT place, seats, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, place, seat) AS nth FROM (SELECT *, unnest(range(1, seats + 1)) AS seat FROM seated WHERE target > 0)),
won AS (SELECT place, count(*) AS quota FROM offered WHERE nth <= seats GROUP BY place),
sharded AS (SELECT d.*, s.place, s.source_size, s.target, s.block, coalesce(won.quota, 0) AS source_quota, drawn % shards AS shard
  FROM doc d JOIN seated s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN won USING (place)),
shard AS (SELECT place, shard, sum(size)::BIGINT AS words, any_value(block) AS block, any_value(source_quota) AS source_quota FROM sharded GROUP BY place, shard),
shard_offered AS (SELECT place, shard, source_quota, row_number() OVER (PARTITION BY place ORDER BY words / (2 * seat - 1) DESC, shard, seat) AS nth
  FROM (SELECT *, unnest(range(1, source_quota + 1)) AS seat FROM shard WHERE words > 0)),
shard_won AS (SELECT place, shard, count(*) AS quota FROM shard_offered WHERE nth <= source_quota GROUP BY place, shard),
wanted AS (SELECT s.*, coalesce(quota, 0) * block AS wanted FROM shard s LEFT JOIN shard_won USING (place, shard)),
rounds AS (SELECT *, CASE WHEN words > 0 THEN least(3, wanted // words) ELSE 0 END AS rounds, words // block AS blocks FROM wanted),
rest AS (SELECT *, CASE WHEN rounds < 3 THEN wanted - rounds * words ELSE 0 END AS rest FROM rounds),
picked AS (SELECT *, least(blocks, rest // block) AS picked FROM rest),
ready AS (SELECT *, least(words - blocks * block, rest - picked * block) AS short,
    CASE WHEN blocks > 0 THEN ('0x' || substr(md5('mix|' || place || '|' || shard), 1, 8))::BIGINT % blocks ELSE 0 END AS start FROM picked),
block_ AS (SELECT place, shard, k * block AS b, (k + 1) * block AS e FROM (SELECT *, unnest(range(0, blocks)) AS k FROM ready) WHERE ((k + 1) * picked + start) // blocks > (k * picked + start) // blocks
  UNION ALL SELECT place, shard, blocks * block, blocks * block + short FROM ready WHERE short > 0),
laid AS (SELECT *, row_number() OVER () AS row, sum(size) OVER (PARTITION BY place, shard ORDER BY drawn, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first FROM sharded),
part AS (SELECT row, sum(least(e, laid.first + size) - greatest(b, laid.first)) AS words FROM laid JOIN block_ USING (place, shard) WHERE e > laid.first AND b < laid.first + size GROUP BY row)
SELECT doc_id, size, source_size, target, (rounds * size + coalesce(part.words, 0))::BIGINT AS taken
FROM laid JOIN ready USING (place, shard) LEFT JOIN part USING (row)
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def queries() -> dict:
    found = [op1_quality, op2_exact_dedup, op3_packing, op4_simhash, op5_url_filter, op6_revisits, op7_language, op8_line_dedup, op9_vectors, op10_byte_bpe, op11_collocations, op12_source_mix, op13_whitening]
    return {f.__name__: f for f in found}


OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS len FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN k ON k.id = v.vec_id LEFT JOIN d ON d.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op6_revisits": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_vectors": OP9_SQL, "op11_collocations": OP11_SQL, "op12_source_mix": OP12_SQL}
