import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from kairoframe.llm import bpe, exact, langid, lines, packing, quality, simhash, urls, vectors, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], SCHEMA)


TEXTS = ["a  b c", "a b\tc", None, "", "🎉 naïve 日本 <|endoftext|>", "x" * 5000, "one two three four five " * 900, "a  b c"]


def test_bpe_is_what_tiktoken_gives_and_round_trips(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = bpe.decode(bpe.encode(frame(spark, TEXTS), RANKS, offsets=True), RANKS).orderBy("doc_id").collect()
    for r, t in zip(rows, TEXTS, strict=True):
        assert r["ids"] == own.encode_ordinary(t or "")
        assert bytes(r["bytes"]) == (t or "").encode() and r["decoded"] == (t or "")
        assert all(0 <= s < e <= len(t or "") for s, e in zip(r["starts"], r["ends"], strict=True))


def test_split_characters_decode_to_replacement(spark):
    ids = bpe.encode(frame(spark, ["🎉"]), RANKS).head()["ids"]
    cut = spark.createDataFrame([(ids[:1],)], "ids array<int>")
    assert "�" in bpe.decode(cut, RANKS).head()["decoded"]


ALL = "true"


def test_exact_dedup_appends_to_its_index(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    got = {r["doc_id"]: r for r in exact.assign(frame(spark, TEXTS), index, [("one", ALL)]).collect()}
    assert got[1]["keep_id"] == 0 and got[0]["group_size"] == 3 and not got[7]["kept"]
    assert bytes(got[2]["digest"]) == hashlib.sha256(b"").digest() and got[3]["keep_id"] == 2
    index.close()
    again = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    more = spark.createDataFrame([(100, "a b c"), (101, "new"), (-5, "a b c")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in exact.assign(more, again, [("two", ALL)]).collect()}
    assert {i: r["kept"] for i, r in found.items()} == {100: False, 101: True, -5: False}
    assert found[100]["keep_id"] == 0 and found[100]["group_size"] == 5
    assert again.rows().where("founder").count() == 6


def test_a_batch_added_again_gets_the_same_verdicts(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "index"), 4)
    docs = frame(spark, TEXTS)
    first = sorted(exact.assign(docs, index, exact.halves(docs)).collect(), key=str)
    size = index.rows().count()
    assert sorted(exact.assign(docs, index, exact.halves(docs)).collect(), key=str) == first and index.rows().count() == size
    # a part of a batch is there already, as after a lost job
    partial = exact.DigestIndex(spark, str(tmp_path / "partial"), 4)
    partial.add(exact.digests(docs).where("doc_id in (0, 1, 7)"), "first")
    assert [r["doc_id"] for r in exact.assign(docs, partial, [("first", ALL)]).where("kept").orderBy("doc_id").collect()] == [0, 2, 4, 5, 6]
    # two writers at once may both found a digest; readers then see the smallest id, once for each document
    index.rows().limit(0).count()
    row = index.rows().where("founder").limit(1).select("digest", F.lit(-9).cast("long").alias("keep_id"), "rows", "founder", F.lit("other").alias("batch"))
    row = spark.createDataFrame(row.collect(), row.schema)
    row.write.insertInto(index.table)
    assert index.verdicts().count() == index.rows().select("digest").distinct().count()


def test_exact_stage_keeps_each_text_once_with_its_columns(spark):
    schema = "doc_id long, text string, digest string, kept boolean, own_digest int, kept_id int, times int, batch string"
    data = [(1, "a  b", "x", True, 1, 2, 3, "z"), (1, "a  b", "x", True, 1, 2, 3, "z"), (None, "a b", "n", None, 5, 5, 5, "y"), (3, "a b", "w", None, 5, 5, 5, "y"), (1, "other", "v", None, 5, 5, 5, "y"), (4, None, "u", None, 5, 5, 5, "y")]
    with exact.new_index(spark) as index:
        docs = spark.createDataFrame(data, schema)
        out = exact.keep_first(docs, index, exact.halves(docs))
    assert out.columns == docs.columns and sorted(out.collect(), key=str) == sorted({data[0], data[4], data[5]}, key=str)


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(frame(spark, TEXTS), path).collect()
    tokenizer = Tokenizer.from_file(path)
    assert 50256 in tokenizer.encode(TEXTS[4], add_special_tokens=False).ids
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_simhash_links_are_those_of_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = set(base)
    for b in base:
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                b ^= 1 << bit
            values.add(b)
    crowd = rng.getrandbits(64)
    values |= {crowd ^ (1 << i) for i in range(64)} | {crowd ^ (3 << i) for i in range(60)}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(0, v) for v in values], "search int, fingerprint long")).collect()
    parent = {v: v for v in values}
    true = dict(parent)

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for r in links:
        assert bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 2
        parent[find(parent, r["a"])] = find(parent, r["b"])
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                true[find(true, a)] = find(true, b)
    assert all((find(parent, a) == find(parent, b)) == (find(true, a) == find(true, b)) for a in values for b in values)


def test_simhash_of_empty_and_null_texts(spark):
    rows = {r["doc_id"]: r for r in simhash.components(frame(spark, [None, " ", "a b"])).collect()}
    assert rows[0]["fingerprint"] == "0" * 16 and rows[1]["component_id"] == 0 and rows[2]["component_id"] == 2


def test_parities_never_exceed_what_sets_differ_in():
    rng = np.random.default_rng(5)
    for size in (0, 1, 5, 63, 64, 65, 700, 3000):
        base = rng.integers(-(1 << 63), 1 << 63, size, dtype=np.int64)
        for extra in (0, 1, 40, 900):
            for gone in (0, size // 10, size):
                other = np.concatenate([base[gone:], rng.integers(-(1 << 63), 1 << 63, extra, dtype=np.int64)])
                apart = len(np.setxor1d(base, other))
                bound = simhash.least_apart(simhash.parity(base), simhash.parity(other))
                assert bound <= apart and (apart > 0 or bound == 0)


def template_copies(base, copies, changed, seed):
    """Copies of a template with some words of their own each, the template last."""
    rng = random.Random(seed)
    texts = []
    for c in range(copies):
        own = list(base)
        for n, at in enumerate(rng.sample(range(len(base)), changed)):
            own[at] = f"own{c}x{n}"
        texts.append(own)
    return [" ".join(t) for t in [*texts, base]]


def sets_of(texts):
    return [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]


def kept_by_brute_force(texts, threshold=None):
    """Who stays if all pairs are tried, or those that a fingerprint brings within the threshold."""
    prints = [simhash.sketch(t)[0] for t in texts] if threshold is not None else None
    sets = sets_of(texts)
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] == least[j] or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            near = prints is None or any((p ^ q).bit_count() <= threshold for p, q in zip(prints[i], prints[j], strict=True))
            if near and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    return sorted(set(least))


def verified():
    words = [f"v{i}" for i in range(400)]
    return [" ".join(words), " ".join([*words[:200], "changed", *words[201:]]), " ".join(w for i, w in enumerate(words) if i % 3)]


def members():
    """1 and 2 are similar; 0 has the same words in another order, and the least id."""
    words = [f"m{i}" for i in range(200)]
    return [" ".join(w) for w in (random.Random(2).sample(words, len(words)), words, words[:100] + [words[101], words[100]] + words[102:])]


def of_lengths():
    """Copies with words replaced all over, a passage replaced, appended or cut, of three lengths."""
    rng = random.Random(6)
    texts = []
    for length in (40, 150, 800):
        for t in range(40):
            base = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(length)]
            spread = list(base)
            for at in rng.sample(range(length), max(1, length // 60)):
                spread[at] = f"x{t}"
            at = rng.randrange(length - length // 12)
            block = base[:at] + [f"y{t}b{i}" for i in range(length // 15)] + base[at + length // 15 :]
            for other in (base, spread, block, base + [f"z{t}a{i}" for i in range(length // 10)], base[:at] + base[at + length // 12 :]):
                texts.append(" ".join(other))
    return texts


def linked_copies():
    rng = random.Random(1)
    return template_copies([f"w{rng.randrange(10**6)}" for _ in range(122)], 200, 2, 1)


def equal_copies():
    rng = random.Random(4)
    return template_copies([rng.choice("pqrstuv") * 3 for _ in range(400)], 100, 7, 9)


SCENES = {f.__name__: f for f in (verified, members, of_lengths, linked_copies, equal_copies)}


@pytest.fixture(scope="module")
def near(spark):
    """(texts, places that stay) of each scene; all go through one run, as they have no words in common."""
    made = {name: f() for name, f in SCENES.items()}
    offsets = {name: 10_000 * i for i, name in enumerate(made)}
    rows = [(offsets[name] + i, t, "en", None, None) for name, texts in made.items() for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).select("doc_id").collect()}
    return {name: (texts, [i for i in range(len(texts)) if offsets[name] + i in kept]) for name, texts in made.items()}


@pytest.mark.parametrize("scene", ["verified", "members", "linked_copies"])
def test_all_similar_documents_are_found(near, scene):
    texts, kept = near[scene]
    assert kept == kept_by_brute_force(texts) and len(kept) < 5


def test_copies_of_one_fingerprint_are_all_tried(near):
    texts, kept = near["equal_copies"]
    assert kept == kept_by_brute_force(texts, 1)


def test_similar_texts_are_found_in_every_length(near):
    """Nine of ten at least of what should go, of each length."""
    texts, kept = near["of_lengths"]
    wanted = set(kept_by_brute_force(texts))
    assert wanted <= set(kept)
    for part in (range(0, 200), range(200, 400), range(400, 600)):
        assert len(set(part) - set(kept)) >= 0.9 * len(set(part) - wanted)


def test_near_stage_on_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(60))
    near = words.replace("w59", "changed")
    schema = "doc_id long, text string, own_id int, gone_print string, key int, label string"
    data = [(7, near), (2, words), (2, words), (2, "quite other text under that id, of some length"), (None, words + " "), (None, None), (9, ""), (9, None), (5, " \t"), (1, "two words"), (3, "TWO words"), (3, "three words here")]
    rows = [(*r, 4, "p", 5, "l") for r in data]
    out = simhash.keep_one(spark.createDataFrame(rows, schema))
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    # an empty and a null text under one id have equal prints, so one of them stays
    assert out.columns == ["doc_id", "text", "own_id", "gone_print", "key", "label"]
    assert sorted(map(str, kept)) == sorted(map(str, [(2, words), data[3], (None, None), kept[[k[0] for k in kept].index(9)], (5, " \t"), (1, "two words"), (3, "three words here")]))


def test_fingerprints_by_hand(spark):
    def naive(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if not words:
            return 0
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = [*TEXTS, "ÀB Àb a", "a\u00a0b c\x1cd e", "A b c A b c A b c", "One", "x y"]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [f"{naive(t):016x}" for t in texts]


@pytest.mark.parametrize("threshold,blocks", [(2, simhash.LONG), (1, simhash.LONG), (1, simhash.SHORT), (2, simhash.SHORT)])
def test_anchors_bring_all_near_words_together(threshold, blocks):
    """A word within the threshold of a fingerprint is sent to that one's home; anchors are code words."""
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    width = 64 if blocks == simhash.LONG else 46
    moved = values.copy()
    for i in range(len(moved)):
        for bit in rng.choice(width, rng.integers(0, threshold + 1), replace=False):
            moved[i] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
    rows, sent = simhash.anchors(moved, threshold, blocks)
    homes = simhash.homes_of(values, blocks)
    assert set(zip(range(300), homes.tolist())) <= set(zip(rows.tolist(), sent.tolist()))
    assert (simhash.homes_of(sent, blocks) == sent).all()


def test_vectors_through_several_blocks_and_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "FILED", 24)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 12))
    rows = np.concatenate([base + 0.04 * rng.normal(size=base.shape) for _ in range(4)])  # doubles, not floats
    data = [(i, [float(x) for x in v], "one") for i, v in enumerate(rows)]
    got = {r["vec_id"]: r for r in vectors.components(spark.createDataFrame(data, "vec_id long, embedding array<double>, label string"), probes=3).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98).sum(1) - 1
    assert np.mean([got[i]["n_links"] for i in range(len(rows))]) >= 0.98 * linked.mean()
    assert all(got[i]["n_links"] <= linked[i] for i in range(len(rows)))


def test_doubles_are_compared_as_doubles(spark):
    a, b = [1.0, 0.0], [0.98 + 1e-12, float(np.sqrt(1 - (0.98 + 1e-12) ** 2))]
    low = [0.98 - 1e-9, float(np.sqrt(1 - (0.98 - 1e-9) ** 2))]
    rows = spark.createDataFrame([(1, a, 1), (2, b, 1), (3, a, 2), (4, low, 2)], "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["n_links"] for r in vectors.components(rows).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(80, 16))
    rows = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), base[:5]]).astype(np.float32)
    data = [(i, [float(x) for x in v], i % 3 if i < 160 else (i - 160) % 3) for i, v in enumerate(rows)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0] * 16, None)]
    got = {r["vec_id"]: r for r in vectors.components(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(data)
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    labels = np.array([d[2] for d in data[: len(rows)]])
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :])
    assert [got[i]["n_links"] for i in range(len(rows))] == (linked.sum(1) - 1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903))


def test_url_rules_and_odd_urls(spark):
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/")]
    data = [(1, "http://A.Example.com/en/7?x"), (2, "https://com/en/1"), (3, "http://notcom/en/"), (4, None), (5, "no scheme"), (6, "http://x.net/de/1#a"), (6, "http://x.net/de/1#a")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(data, "page_id long, url string"), rules).collect()}
    assert (got[1]["host"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "example.com/en/7", "allow")
    assert got[2]["rule"] == "com/en/" and got[3]["rule"] is None and got[4]["host"] == got[5]["path"] == ""
    assert got[6]["verdict"] == "block"


def test_language_and_quality_on_small_tables(spark):
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)] + [(98, None, "en"), (99, "123 !", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(10))
    assert got[98]["lang_pred"] == got[99]["lang_pred"] == "und"
    assert langid.identify(docs, langid.learn(docs.limit(0))).where("lang_pred <> 'und'").isEmpty()
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(10)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.learn(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[0] > scores[1]


def test_line_dedup_keeps_first_occurrences(spark):
    docs = frame(spark, ["a\nb\nc\nd", "x\na\nb \nc\ny", None, "", "q\nq\nq\nq\nq", "\n\n\n\n"])
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeats(docs).collect()}
    assert got == {0: "a\nb\nc\nd", 1: "x\ny", 2: None, 3: "", 4: "q\nq\nq", 5: "\n\n\n\n"}


def test_line_dedup_tells_texts_under_one_id_apart(spark):
    texts = [(1, "p\nq\nr\nown"), (2, "unique one\nunique two\nunique three\nunique four"), (2, "a\np\nq\nr"), (2, "a\np\nq\nr"), (3, "own\nx\ny\nz"), (3, "x\ny\nz\nown"), (None, "p\nq\nr"), (4, "line\n" * 50_000)]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in lines.drop_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    first, second = sorted(["own\nx\ny\nz", "x\ny\nz\nown"], key=lambda t: hashlib.md5(t.encode()).digest())
    wanted = [(0, "p\nq\nr"), (1, "p\nq\nr\nown"), (2, "unique one\nunique two\nunique three\nunique four"), (2, "a"), (2, "a"), (3, first), (3, "own"), (4, "line\nline\nline\n")]
    assert got == sorted(wanted)


def test_revisits(spark):
    schema = "record_id long, uri string, ts long, status int, headers map<string,string>, body string"
    data = [
        (1, "http://www.a.com/x/", 100, 200, {"ETag": '"1"', "Content-Type": "text/html"}, "old"),
        (2, "https://a.com/x?utm_source=f", 200_000, 200, {"etag": '"2"'}, "new"),
        (3, "http://a.com/x", 150, 304, {"etag": 'W/"1"', "Content-Type": "x", "Age": "3"}, None),
        (4, "http://a.com/x", 300_000, 304, {"etag": '"1"'}, None),
        (5, "http://a.com/x", 50, 304, {}, None),
        (6, None, None, 304, None, None),
    ]
    got = {r["record_id"]: r for r in warc.resolve(spark.createDataFrame(data, schema)).collect()}
    assert got[3]["body"] == "old" and got[3]["headers"] == {"etag": 'W/"1"', "age": "3", "content-type": "text/html"}
    assert [got[i]["outcome"] for i in (4, 5, 6)] == ["mismatch", "unmatched", "unmatched"] and got[4]["source_id"] == 2


def test_revisits_of_repeated_records(spark):
    """Against loops: responses that occur twice, revisits that occur twice or share an id, no ids, no rows."""
    schema = "record_id long, uri string, ts long, status int, headers map<string,string>, body string"
    rng = random.Random(5)
    data = []
    for _ in range(60):
        url, ts, rid = f"http://h{rng.randrange(3)}.com/", rng.randrange(12), rng.choice([None, *range(4)])
        if rng.random() < 0.5:
            data += [(rid, url, ts, 200, {"etag": f"{rid}"}, f"b{rid}{url}{ts}")] * rng.choice([1, 1, 2])
        else:
            data += [(rid, url, ts, 304, {"etag": f"{rng.choice([None, 1, 2])}"}, None)] * rng.choice([1, 1, 2])
    wanted = []
    for rid, url, ts, status, headers, _ in data:
        if status == 304:
            before = [(t, r is not None, r or 0, h["etag"], b) for r, u, t, s, h, b in data if s == 200 and u == url and t < ts]
            best = max(before, default=None)
            source = None if best is None or not best[1] else best[2]
            outcome = "unmatched" if best is None else "resolved" if best[3] == headers["etag"] else "mismatch"
            wanted.append((rid, ts, source, outcome, best[4] if outcome == "resolved" else None))
    for days in (86_400, 4):
        got = warc.resolve(spark.createDataFrame(data, schema), days).collect()
        assert sorted(map(str, wanted)) == sorted(str((r["record_id"], r["ts"], r["source_id"], r["outcome"], r["body"])) for r in got)
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0


def test_quality_against_a_naive_trainer(spark):
    """The bag of a text by loops, and the score as the softmax of the average of its vectors."""
    text = "the cat the  cat\nzoë 🎉 the cat"
    ids, counts = quality.bag(text)
    words = text.split()
    assert counts.sum() == sum(1 + sum(max(0, len(w) + 2 - n + 1) for n in quality.GRAMS) for w in words) + quality.PAIR * (len(words) - 1)
    found, ends, hashes = quality.features(["the", "cat"])
    again = quality.features(["cat"])
    assert found[ends[0] :].tolist() == again[0].tolist() and hashes[1] == again[2][0]
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=(2 * quality.BUCKETS, quality.WIDTH)).astype(np.float32), rng.normal(size=(2, quality.WIDTH)).astype(np.float32), np.array([0.1, -0.2], np.float32))
    mean = sum(int(c) * model.table[i].astype(float) for i, c in zip(ids, counts, strict=True)) / counts.sum()
    logits = model.weights @ mean + model.bias
    share = 1 / (1 + np.exp(logits[0] - logits[1]))
    scorer = quality.Scorer(model)
    assert np.allclose(scorer([text, "", None, text * 3000])[[0, 1]], [share, 1 / (1 + np.exp(0.3))], atol=1e-5)
    assert np.allclose(scorer([text]), scorer(["other words", text])[1])


def test_quality_learns_from_rows_of_any_length(spark):
    """Only the long texts tell the classes apart; one class alone, no label and an empty table have defined scores."""
    texts = [("good sense " if i % 2 else "spam junk ") * 4_000 for i in range(12)] + ["the same"] * 4
    docs = frame(spark, texts).withColumn("Score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(0, 0), (None, 1), (3, 7)], "doc_id long, quality int")
    rows = quality.score(docs, quality.learn(docs, labels))
    scores = {r["doc_id"]: r["score"] for r in rows.collect()}
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert all((scores[i] > 0.5) == bool(i % 2) for i in range(12))
    one = quality.learn(docs, labels.where("quality = 1"))
    assert not one.learned and quality.score(docs, one).where("score < 0.99").isEmpty()
    none = quality.learn(docs, labels.limit(0))
    assert quality.score(docs, none).where("score <> 0.5").isEmpty() and quality.score(docs.limit(0), none).isEmpty()


def test_language_vectors_by_loops(spark):
    """A bundle is the sum over trigrams of products of rotated letter vectors, also across slices."""
    def naive(text):
        bare = "".join(c.lower() if c.isalpha() else " " for c in text)
        points = [ord(c) for c in f" {' '.join(bare.split())} "]
        v = {p: langid.letter_vectors(np.array([p]))[0].astype(int) for p in set(points)}
        return sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(points, points[1:], points[2:]))

    texts = ["Der Hund, 42 Katzen!", "x", "ab " * 50]
    found, has = langid.bundles(texts)
    assert has.all() and all((found[i] == naive(t)).all() for i, t in enumerate(texts))
    whole = langid.bundles(["der hund " * 90_000])[0][0]  # over two slices
    assert (whole == naive("der hund der hund ")[None, :] + 89_998 * (naive("der hund der hund der hund ") - naive("der hund der hund "))).all()


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", "clash"), (2, "der hund und die katze", "de", "clash"), (None, "the dog", "en", "x"), (3, "", "en", "x"), (3, "1 2", None, "x")], "doc_id long, text string, lang string, LANG_PRED string")
    rows = langid.identify(docs, langid.learn(docs))
    assert rows.columns == ["doc_id", "text", "lang", "lang_pred", "score", "likeness"] and rows.where("text = 'the dog'").head()["lang_pred"] == "en"
    empty = docs.limit(0)
    assert langid.learn(empty) == {} and langid.identify(empty, {}).isEmpty()


def features_by_hand(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    url = url or ""
    size = max(1, len(url))
    shares = [url.count(c) / size for c in set(url)]
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "digit_ratio": sum(c in "0123456789" for c in url) / size,
        "entropy": -sum(p * np.log2(p) for p in shares), "parameters": sum(c in "?&;" for c in url), "hyphens": url.count("-"), "dots": url.count("."), "longest_label": max(map(len, host.split("."))),
    }


def test_url_features_by_hand(spark):
    data = ["http://A-b.Example.com/en/7?x=1&y=2#z", "https://com", "no scheme", "", None, "ftp://x.y.z//a//b?q", "http://h/" + "é1" * 3000]
    rows = spark.createDataFrame([(u,) for u in data], "url string")
    rows = urls.lexical(rows.withColumn("host", urls.host(F.col("url"))).withColumn("path", urls.path(F.col("url"))))
    for r in rows.collect():
        wanted = features_by_hand(r["url"])
        assert {k: pytest.approx(v, abs=1e-9) for k, v in wanted.items()} == {k: r[k] for k in wanted}, r["url"]


def test_url_shares_leave_the_own_fold_out(spark):
    schema = "host string, suffix_1 string, suffix_2 string, label double"
    rows = [(f"h{i % 30}.com", "com", f"h{i % 30}.com", [1.0, 0.0, None][i % 7 % 3]) for i in range(200)] + [("c.org", "org", "c.org", 1.0)]
    fold = {r["host"]: r["fold"] for r in spark.createDataFrame(rows, schema).selectExpr("host", f"pmod(xxhash64('fold', host), {urls.FOLDS}) fold").collect()}
    for turned in (rows, [(*r[:3], None if r[3] is None else 1 - r[3]) if i == 1 else r for i, r in enumerate(rows)]):
        for r in urls.suffix_statistics(spark.createDataFrame(turned, schema)).collect():
            seen = [x[3] for x in turned if x[1] == r["suffix_1"] and x[3] is not None and (r["label"] is None or fold[x[0]] != fold[r["host"]])]
            assert r["suffix_1_blocked"] == pytest.approx((sum(seen) + 1) / (len(seen) + 2))
            assert r["suffix_1_rows"] == pytest.approx(np.log1p(sum(x[1] == r["suffix_1"] for x in turned)))


def area(scored):
    """The chance that a row of label 1 scores above one of label 0, ties counting half."""
    ones, zeros = [s for s, y in scored if y], [s for s, y in scored if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_hosts_held_out_are_told_apart(spark):
    rng = random.Random(8)

    def url(kind, host):
        if kind:
            return f"http://{host}.{rng.choice(['biz', 'biz', 'com'])}/" + "".join(rng.choice("0123456789abc-") for _ in range(rng.randrange(10, 40))) + "?a=1&b=2"[: rng.choice([0, 4, 8])]
        return f"http://{host}.{rng.choice(['org', 'org', 'com'])}/" + "/".join(rng.choice(["news", "about", "team", "2024"]) for _ in range(rng.randrange(1, 5)))

    data = [(i, i % 10 < 9, f"host{i % 40}") for i in range(600)]
    data = [(i, kind, url(kind, host), i % 40 < 30) for i, kind, host in data]
    labelled = spark.createDataFrame([(u, float(k)) for _, k, u, known in data if known], "url string, label double")
    pages = spark.createDataFrame([(i, u) for i, _, u, known in data if not known], "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, [], labelled).collect()}
    assert area([(got[i]["score"], k) for i, k, _, known in data if not known]) > 0.95
    assert len({r["score"] for r in got.values()}) > 10 and {r["verdict"] for r in got.values()} == {"allow", "block"}


def test_trees_learn_and_judge_urls(spark):
    """Long digit paths are blocked among the labelled URLs, so the trees block others like them; one class alone and no rows."""
    rng = random.Random(8)
    make = lambda bad: f"http://h{rng.randrange(50)}.org/{''.join(rng.choice('0123456789' if bad else 'abcdef') for _ in range(40 if bad else 6))}"
    labelled = spark.createDataFrame([(make(i % 2), float(i % 2)) for i in range(400)], "url string, label double")
    pages = spark.createDataFrame([(i, make(i % 2), "clash", 1.0) for i in range(60)] + [(None, None, "c", 0.0)], "page_id long, url string, verdict string, label double")
    got = urls.judge(pages, [("block", "com/x")], labelled).collect()
    assert len(got) == 61 and all((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got if r["page_id"] is not None)
    only = urls.judge(pages, [("block", "org/")]).collect()
    assert {r["verdict"] for r in only} == {"block"} and urls.judge(pages.limit(0), [("block", "org/")]).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_decoding_goes_through_the_byte_table():
    table = bpe.character_bytes()
    tokens = bpe.vocabulary(RANKS)
    assert len(table) == 256 and {bytes(map(table.__getitem__, t)): i for t, i in list(tokens.items())[:2000]} == {k: v for k, v in bpe.read_ranks(RANKS).items() if v in set(list(tokens.values())[:2000])}


def test_columns_that_clash_come_through(spark):
    docs = frame(spark, TEXTS).withColumn("IDS", F.lit("x")).withColumn("sequence_id", F.lit("y")).withColumn("n_lines", F.lit("z")).withColumn("_gone", F.lit(1)).withColumn("_lines", F.lit(2))
    assert bpe.encode(docs, RANKS).columns.count("ids") == 1
    assert packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).where("doc_id = 0").count() == 1
    out = lines.drop_repeats(docs)
    assert {"_gone", "_lines"} <= set(out.columns) and out.where("_gone = 1 and _lines = 2").count() == len(TEXTS)


@pytest.mark.parametrize("make", [lambda d: bpe.encode(d, RANKS), lambda d: simhash.components(d), lambda d: lines.drop_repeats(d), lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: exact.assign(d, exact.new_index(d.sparkSession), exact.halves(d)), simhash.keep_one, lambda d: vectors.components(d.selectExpr('doc_id vec_id', 'array(1.0D) embedding', 'lang label'))])
def test_empty_tables(spark, make):
    assert make(frame(spark, []).where("doc_id >= 0")).count() == 0
