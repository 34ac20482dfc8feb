"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import automaton, idstore, linededup, queries, repetition, secret_scan, simhash, toollinks, toxicity, wumanber, zipwarc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, score string, ids string, component string, fp string, k string, h string"
LONG = "word " * 60_000 + "x" * 50_000
PASSAGE = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))


@pytest.fixture(scope="module")
def odd(spark):
    texts = [(1, "plain words here"), (1, "plain words here"), (2, None), (3, ""), (None, "no key at all"), (None, None), (4, LONG), (5, " \n\t "), (6, PASSAGE), (7, "intro\n" + PASSAGE + "\nouttro")]
    return spark.createDataFrame([(k, t, None, None, None, 1, "s", "i", "c", "f", "k", "h") for k, t in texts], SCHEMA).repartition(3)


def model():
    toxic = [(f"some text {i} idiot there {w}", 1) for i, w in enumerate("moron scum idiot loser moron idiot scum loser moron idiot".split() * 3)]
    return toxicity.fit(toxic + [(f"some text {i} nice there {w}", 0) for i, w in enumerate("house garden river cloud stone".split() * 12)])


def test_row_by_row_operators(spark, odd):
    empty = odd.limit(0)
    items = spark.createDataFrame([("a", "plain words here"), ("b", None), (None, "x")], "item_id string, text string")
    import public_tokenizers

    made = [
        lambda d: automaton.bpe_round_trip(d.drop("ids"), queries.vocabulary("word_bpe_49k.json")), repetition.quality, lambda d: toxicity.score(d, model()), simhash.fingerprints,
        lambda d: wumanber.contamination(d, items), lambda d: secret_scan.find_secrets(d, queries.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    ]
    for f in made:
        assert f(odd).count() == 10 and f(empty).count() == 0
    hits = {(r.doc_id, r.n_hit) for r in wumanber.contamination(odd, items).collect()}
    assert (1, 3) in hits and (2, 0) in hits and (None, 0) in hits
    assert wumanber.contamination(odd, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    with pytest.raises(ValueError):
        simhash.fingerprints(odd, key="fp")


def test_blocks_of_items(spark, odd):
    items = spark.createDataFrame([(str(i), f"w{i}x0 w{i}x1 w{i}x2 w{i}x3 w{i}x4 w{i}x5 w{i}x6 w{i}x7") for i in range(4)] * 2, "item_id string, text string")
    one, many = (sorted(map(str, wumanber.contamination(odd, items, block_bytes=b).collect())) for b in (1 << 20, 10))
    assert one == many
    one, many = (sorted(map(str, wumanber.drop_contaminated(odd, items, block_bytes=b).select("doc_id", "text", "k", "h").collect())) for b in (1 << 20, 10))
    assert one == many and len(one) == 8 and wumanber.drop_contaminated(odd, items.limit(0)).count() == 10


def test_id_store(spark, odd, monkeypatch):
    store = idstore.write_store(odd, idstore.new_root(spark), queries.vocabulary("byte_bpe_50k.json"))
    got = idstore.lookup(odd, store).collect()
    assert len(got) == 10 and sum(r.doc_id is None for r in got) == 2 and min(r.start for r in got) == 0
    assert sorted(r.start for r in got) == np.cumsum([0, *[r.n for r in sorted(got, key=lambda r: r.start)]])[:-1].tolist()
    assert idstore.lookup(spark.createDataFrame([(99,)], "doc_id bigint"), store).count() == 0
    few = spark.createDataFrame([(k,) for k in (6, 7, None, 99)], "doc_id bigint")
    monkeypatch.setattr(idstore, "FEW", 0)
    whole = sorted(map(str, idstore.lookup(few, store).collect()))
    monkeypatch.setattr(idstore, "FEW", 1 << 40)
    assert len(whole) == 4 and sorted(map(str, idstore.lookup(few, store).collect())) == whole
    want = {r.doc_id: r for r in idstore.lookup(few, store).collect()}
    bucket = few.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(store["buckets"])).alias("b")).where("doc_id = 6").first().b
    assert [x.tobytes() for x in idstore.read_one(store, 6, bucket)] == [bytes(want[6].ids)] and idstore.read_one(store, 99, bucket) == []
    nothing = idstore.write_store(odd.limit(0), idstore.new_root(spark), queries.vocabulary("byte_bpe_50k.json"))
    assert idstore.lookup(odd, nothing).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 50_000))
    h = idstore.PerfectHash.build(keys)
    assert sorted(h.find(keys).tolist()) == list(range(len(keys)))
    assert (h.find(keys + 1) >= 0).sum() <= 2


def test_line_dedup(spark, odd):
    got = [(r.doc_id, r.text, r.removed) for r in linededup.drop_repeated_lines(odd, removed="removed").collect()]
    assert len(got) == 10
    assert ((7, "intro\nouttro", 4) in got) and ((6, PASSAGE, 0) in got) and ((2, None, 0) in got)
    assert linededup.drop_repeated_lines(odd.limit(0)).count() == 0


def test_line_dedup_deals_hot_fingerprints_out(spark, monkeypatch):
    """A passage that nearly all texts share is taken out of all but the first, however its places are dealt out."""
    docs = spark.createDataFrame([(i, f"own line {i}\n{PASSAGE}\nend {i}") for i in range(60)], "doc_id bigint, text string")
    want = [(i, f"own line {i}\n{PASSAGE}\nend {i}" if not i else f"own line {i}\nend {i}") for i in range(60)]
    for share in (7, 4096):
        monkeypatch.setattr(linededup, "SHARE", share)
        assert sorted((r.doc_id, r.text) for r in linededup.drop_repeated_lines(docs).collect()) == want


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(200):
        own = lambda n: [(int(x), int(w)) for x, w in zip(rng.integers(1 << 60, size=n), rng.integers(1, 30, n), strict=True)]
        shared = own(12)
        while sum(w for _, w in shared) < 50:
            shared = own(12)
        a, b = own(int(rng.integers(0, 9))) + shared + own(5), own(int(rng.integers(0, 9))) + shared + own(3)
        prints = [{x[0] for x in linededup.winnow([h for h, _ in t], [w for _, w in t], 25, 50)} for t in (a, b)]
        assert prints[0] & prints[1]


def test_line_dedup_beyond_the_first_place(spark):
    # A notice of 30 words in the middle of many passages; each passage is in several documents.
    rng = np.random.default_rng(17)
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(1 << 40, size=n))
    notice, docs = [line(15), line(15)], []
    for _ in range(25):
        passage = [line(9), line(11), *notice, line(12), line(8)]
        docs += [[line(7), *passage, line(5)] for _ in range(4)]
    for _ in range(40):  # and any runs of few lines in common
        a = docs[int(rng.integers(len(docs)))]
        low = int(rng.integers(len(a)))
        docs.append([line(3), *a[low : low + int(rng.integers(1, 8))], line(30)])
    texts = [docs[i] for i in rng.permutation(len(docs))]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.text.split("\n") for r in linededup.drop_repeated_lines(df).collect()}
    seen: set[tuple] = set()
    for i, t in enumerate(texts):
        dead, own = set(), set()
        for a in range(len(t)):
            for b in range(a + 1, len(t) + 1):
                if sum(len(x.split()) for x in t[a:b]) >= 50:
                    own.add(tuple(t[a:b]))
                    dead |= set(range(a, b)) if tuple(t[a:b]) in seen else set()
        seen |= own
        assert not {t[j] for j in dead} & set(got[i])


def test_near_duplicates(spark, odd):
    got = {(r.doc_id, r.component) for r in simhash.near_duplicates(odd.drop("fp", "component")).collect()}
    assert (3, 2) in got and (5, 2) in got and (None, 2) in got and (1, 1) in got
    assert simhash.near_duplicates(odd.drop("fp", "component").limit(0)).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 4, 6] and kept.count(None) == 1
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_keep_one_by_similarity(spark):
    base = [f"t{i}" for i in range(300)]
    near, far = base.copy(), base.copy()
    near[150] = "changed"
    for i in range(0, 300, 6):
        far[i] = f"other{i}"
    docs = spark.createDataFrame([(5, " ".join(base)), (6, " ".join(near)), (7, " ".join(far)), (8, " ".join(base).upper())], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [5, 7]


def test_shard_edges_connect_as_brute_force():
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    f[500:] = f[rng.integers(0, 500, 1000)] ^ (np.uint64(1) << rng.integers(0, 63, 1000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 1000, dtype=np.uint64))
    f = np.unique(f)
    ids = f.view(np.int64)
    a, b = simhash.shard_edges(f[None], ids, f[None], ids, 4)
    again = rng.permutation(len(f))
    assert all(np.array_equal(x, y) for x, y in zip((a, b), simhash.shard_edges(f[None, again], ids[again], f[None], ids, 4), strict=True))
    forest, whole = simhash.Forest(len(f)), simhash.Forest(len(f))
    forest.join(np.searchsorted(f, a.view(np.uint64)), np.searchsorted(f, b.view(np.uint64)))
    x, y = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    whole.join(x, y)
    assert np.array_equal(forest.settle(), whole.settle()) and len(a) < len(f)


def test_block_masks_miss_no_pair():
    rng = np.random.default_rng(2)
    for n, tables in ((0, 1), (1000, 1), (100_000, 5), (1 << 26, 5), (1 << 30, 15), (1 << 40, 35)):
        masks = simhash.block_masks(n, 4)
        assert len(masks) == tables
        for _ in range(500):
            change = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            assert any(not change & m for m in masks)


def test_edges_in_chunks(spark):
    """Shards larger than a chunk are cut, and the same pairs are connected."""
    rng = np.random.default_rng(6)
    f = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFF00000)  # the lowest blocks are equal
    f[1000:] = f[rng.integers(0, 1000, 2000)] ^ (np.uint64(1) << rng.integers(20, 63, 2000, dtype=np.uint64))
    f = np.unique(f)
    df = spark.createDataFrame([(x, x) for x in f.view(np.int64).tolist()], "id bigint, fp bigint")
    x, y = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 4)
    whole = simhash.Forest(len(f))
    whole.join(x, y)
    for chunk in (100, 1 << 15):
        got = np.array([tuple(r) for r in simhash.fingerprint_edges(df, 4, chunk).collect()], np.int64).view(np.uint64)
        forest = simhash.Forest(len(f))
        forest.join(np.searchsorted(f, got[:, 0]), np.searchsorted(f, got[:, 1]))
        assert np.array_equal(forest.settle(), whole.settle())


def test_least_hashes_recall():
    """Sets of similarity 0.8 agree in a band nearly always, sets of 0.4 seldom."""
    rng = np.random.default_rng(4)

    def agree(shared, own, n=2000):
        sets = [rng.integers(0, 1 << 63, shared + 2 * own, dtype=np.uint64) * np.uint64(2) for _ in range(n)]
        left, right = ([s[k] for s in sets] for k in (slice(0, shared + own), np.r_[0:shared, shared + own : shared + 2 * own]))
        a, b = (simhash.least_hashes(np.concatenate(x), np.arange(n + 1) * (shared + own)).view(np.uint32) for x in (left, right))
        return (a == b).any(axis=1).mean()

    assert agree(80, 10) >= 0.998 and agree(40, 30) < 0.7


def test_keep_one_is_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts: dict[tuple, list] = {}
    for r in docs.collect():
        texts.setdefault(tuple(re.findall("[^\x20\x09-\x0D]+", (r.text or "").translate(lower))), []).append(r.doc_id)
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
    graph = simhash.Forest(len(sets))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (both := len(sets[i] & sets[j])) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    graph.join(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    least: dict[int, int] = {}
    for root, ids in zip(graph.settle().tolist(), texts.values(), strict=True):
        least[root] = min(least.get(root, ids[0]), *ids)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(least.values())


def test_packages(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (2, "u", "same"), (3, "u", None), (None, "u", ""), (None, "u", "lone"), (4, "u", "é" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    root = zipwarc.new_root(spark)
    got = [(r.page_id, r.record_type, r.refers_to) for r in zipwarc.read_packages(zipwarc.write_packages(pages, root, package_bytes=500), root).collect()]
    want = [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (None, "revisit", 3), (None, "response", None), (4, "response", None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    clash = pages.select("*", *[F.lit("x").alias(c) for c in ("payload", "record_type", "path", "key", "last", "refers_to", "payload_digest")])
    root = zipwarc.new_root(spark)
    packages = zipwarc.write_packages(clash, root)
    for size in (1, 8 << 20):  # runs of one record, and of all
        assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in zipwarc.read_packages(packages, root, run_bytes=size).collect()) == sorted(map(str, want))
    root = zipwarc.new_root(spark)
    assert zipwarc.read_packages(zipwarc.write_packages(pages.limit(0), root), root).count() == 0
    path = tmp_path / "big.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66_000):
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"0123456789")
    data = path.read_bytes()
    reader = zipwarc.ZipReader(lambda at, n: data[at : at + n], len(data))
    assert len(reader.members) == 66_001 and reader.range("last", 3, 4) == b"3456"


def test_tool_links(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "add", '{"y":2,"x":1}', ["b"]), (1, 2, "b", "add", '{"x":"one","z":1}', []), (1, 4, "c", "none", "{}", ["d"]), (1, 5, "d", "add", "[1]", ["c"]), (2, 0, None, "add", None, None), (2, 1, "r", "add", '{"x":1}', []), (2, 1, "r", "add", '{"x":1}', [])],
        "conversation bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 3, "b", "ok"), (1, 9, "zz", None), (2, 2, "r", "x"), (2, 3, None, "x")], "conversation bigint, turn bigint, call_id string, content string")
    schemas = spark.createDataFrame([("add", '{"required":["x"],"properties":{"x":{"type":"integer"}},"additionalProperties":false}')], "name string, schema string")
    got = toollinks.link(calls, results, schemas).collect()
    at = {(r.kind, r.call_id): r for r in got if r.conversation == 1}
    assert at["call", "a"].place > at["result", "b"].place > at["call", "b"].place  # a uses b's result
    assert at["call", "a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add"}' and at["call", "a"].problems == ["unknown y"]
    assert at["call", "b"].problems == ["type x", "unknown z"] and at["call", "b"].status == "linked"
    assert at["call", "c"].problems == ["unknown tool"] and at["call", "d"].problems == ["not an object"] and at["call", "c"].place > at["call", "a"].place + (1 << 40)
    assert at["result", "zz"].status == "orphan"
    two = sorted((r.kind, str(r.call_id), r.status) for r in got if r.conversation == 2)
    assert two == [("call", "None", "unanswered"), ("call", "r", "linked"), ("call", "r", "linked"), ("result", "None", "orphan"), ("result", "r", "repeated")]
    assert toollinks.link(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_tool_order(spark):
    """A call comes after the results it depends on, wherever these stand; chains of any length, nulls, repeats, long texts, clashing columns."""
    n, shape = 12, "conversation bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>, level int, node string, tool string, schema string"
    rows = [(1, 0, "a", "t", "{}", []), (1, 2, "b", "t", "{}", ["a"])]  # a's result stands at turn 5
    rows += [(2, i, f"c{i}", "t", "{}", [f"c{i + 1}"]) for i in range(n)]  # each needs the next one
    rows += [(3, None, "x", "t", "{}", None), (3, 1, None, "t", "{}", ["x"]), (3, 1, "y", None, None, [None]), (4, 0, "z", "t", '{"s":"' + "w" * 300_000 + '"}', []), (None, 0, "a", "t", "", [])]
    calls = spark.createDataFrame([(*r, 9, "n", "t", "s") for r in rows + rows[-1:]], shape)
    results = spark.createDataFrame([(1, 5, "a", "ok"), *[(2, i, f"c{i}", "r") for i in range(n)], (3, 2, "x", None), (4, 1, "z", "v" * 300_000), (None, 3, "a", "")], "conversation bigint, turn bigint, call_id string, content string")
    schemas = spark.createDataFrame([("t", "{}"), ("t", '{"required":["q"]}'), (None, "{}")], "name string, schema string")
    got = toollinks.link(calls, results, schemas).collect()
    at = {(r.conversation, r.kind, r.call_id): r for r in got}
    assert len(got) == len(rows) + 1 + n + 4
    assert at[1, "call", "a"].place < at[1, "result", "a"].place < at[1, "call", "b"].place
    order = [at[2, kind, f"c{i}"].place for i in reversed(range(n)) for kind in ("call", "result")]
    assert order == sorted(order) and len(set(order)) == 2 * n
    assert at[3, "result", "x"].place < at[3, "call", None].place and at[3, "call", "y"].json == '{"arguments":null,"id":"y"}'
    assert at[4, "call", "z"].problems == ["missing q"] and len(at[4, "result", "z"].json) > 300_000  # the least of a tool's schemas
    assert at[None, "call", "a"].status == "unanswered" and at[None, "result", "a"].status == "orphan"


def test_chat_calls_keep_every_row(spark):
    said = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 3, None, "q"), (None, 0, "user", "u"), (2, None, "user", ""), (2, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    calls, results = toollinks.chat_calls(said)
    got = toollinks.link(calls, results, spark.createDataFrame(queries.CHAT_SCHEMAS, "name string, schema string")).collect()
    assert len(got) == 7 and sorted(r.call_id for r in got if r.conversation == 1) == ["c1-1", "c1-1", "c1-3", "s1-0"]
    assert max((r for r in got if r.conversation == 1), key=lambda r: r.place).call_id == "s1-0"


def test_pipeline(spark, small):
    out = corpus_pipeline.run(spark, small)
    n, first = out.count(), {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert 0 < n <= len(first) and out.columns == ["doc_id", "ids", "decoded"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert stage(spark, docs.limit(0), small).count() == 0


def test_stages_on_odd_documents(spark, small, odd):
    """Each stage alone on nulls, empty and long texts, repeated rows and columns with clashing names."""
    extra = odd.withColumns({"n_chars": F.length("text").cast("bigint"), "runs": F.lit("r"), "size": F.lit(1), "c": F.lit(2), "part": F.lit(3), "content": F.lit("t"), "least": F.lit("l"), "items": F.lit(None).cast("string")})
    left = dict.fromkeys(("toxicity", "line_dedup", "decontamination"), 10) | {"near_dedup": 5, "bpe": 10}
    for name, stage in corpus_pipeline.STAGES:
        docs = extra.drop("ids") if name == "bpe" else extra
        made = stage(spark, docs, small)
        assert made.count() == left[name], name
        if name != "bpe":
            assert made.columns == docs.columns and {r.runs for r in made.collect()} == {"r"}


def test_keep_one_in_a_family(spark):
    # Texts that resemble each other at about 0.7, so that most candidates fail; pairs of them at 0.83.
    rng = np.random.default_rng(11)
    n, family, planted = 400, 240, 60
    base, texts = [f"b{i}" for i in range(n)], []

    def changed(words, share, tag):
        out = words.copy()
        for i in rng.choice(n // 5, int(share * n / 5), replace=False) * 5:
            out[i] = f"{tag}w{i}"
        return out

    for i in range(family):
        texts.append(changed(base, 0.18, f"f{i}"))
    for i in range(planted):
        texts.append(changed(texts[i], 0.09, f"p{i}"))
    sets = [{tuple(w[i : i + 5]) for i in range(n - 4)} for w in texts]
    graph = simhash.Forest(len(sets))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if (both := len(sets[i] & sets[j])) >= 0.8 * (len(sets[i]) + len(sets[j]) - both)]
    graph.join(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    assert {(family + i, i) for i in range(planted)} <= set(pairs) and np.median([len(sets[0] & s) / len(sets[0] | s) for s in sets[1:family]]) < 0.75
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == np.unique(graph.settle()).tolist()
