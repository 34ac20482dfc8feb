"""Every opN query against plain Python over its whole table, and its edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from palimpsest.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_op1_is_the_library(spark, small, docs):
    t, got = library("word_bpe_49k.json"), rows(q.op1_bpe_automaton(spark, small))
    assert len(got) == len(docs)
    for d, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[d].decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_op2_is_the_library(spark, small, docs):
    t, got, start = library("byte_bpe_50k.json"), rows(q.op2_id_store(spark, small)), 0
    assert len(got) == len(docs)
    for d, text in sorted(docs):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def longest_repeat(words):
    order = sorted(range(len(words)), key=lambda i: words[i : i + 400])
    best = [0] * len(words)
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


def test_op3_counts(spark, small, docs):
    got = rows(q.op3_quality_rules(spark, small))
    for d, text in docs:
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        best = longest_repeat(words)
        span = {j for i, n in enumerate(best) if n >= 16 for j in range(i, i + n)}
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        longest = max((n for n in best if n >= 8), default=0)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(hit), failed)
        assert (r.repeat_words, r.longest) == (len(span), longest)
        assert r.kept == (not failed and len(span) <= 0.25 * len(words) and longest <= 250)


def test_op4_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(q.op4_toxicity(spark, sf))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    caught, flagged = [b for a, b in held if a == 1], [b for a, b in held if a == 0]
    assert np.mean([a == b for a, b in held]) >= 0.88 and np.mean(caught) >= 0.7 and np.mean(flagged) <= 0.05
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op4_gaps(spark):
    from palimpsest.llm import toxicity

    sf = "/root/testdata/sf0.01"
    model = q.toxicity_model(spark, sf)
    known = [w for w in ("idiot", "moron", "stupid", "pathetic", "loser", "trash") if model.probability(model.words([w]))[0] >= 0.7]
    assert len(known) >= 3
    p = {w: model.probability(model.words([w[:2] + "-" + w[2:], w[:3] + w[2] + w[3:]])) for w in known}
    clean = model.probability(model.words(["thing", "ration", "erhean", "schule", "éauxtion"]))
    assert np.mean([v.max() for v in p.values()]) > 10 * clean.max() or min(v.max() for v in p.values()) > clean.max()
    import pyarrow as pa

    whole = lambda text: model.probability(toxicity.text_values(model, pa.array([text])))[0]
    assert all(whole(f"you {mark.join(w)}, really") >= 0.7 for w in known for mark in ".-*_ ")  # all letters apart
    assert np.mean([whole(f"you {w[:3]}{mark}{w[3:]}!") >= 0.7 for w in known for mark in ".-*"]) >= 0.9
    assert max(whole(x) for x in ("a-b-c", "U.S.A. and the U.K.", "e.g. i.e. 1.2.3.4")) < 0.7
    spaced = toxicity.text_values(model, pa.array([" ".join(known[0]), "a b", "", "\n"]))
    assert spaced[0] > spaced[1] >= spaced[2] == spaced[3]


def test_op4_kernel():
    """Norms, explicit images and the table's scores against sums over all triples of places."""
    from itertools import combinations

    from palimpsest.llm import toxicity

    rng, decay = np.random.default_rng(8), 0.5
    alphabet = toxicity.Alphabet("abcd漢字")

    def image(row):
        out = Counter()
        own = [x for x in row if x >= 0]
        for i, j, k in combinations(range(len(own)), 3):
            out[own[i], own[j], own[k]] += decay ** (k - i - 2)
        return out

    words = ["".join(rng.choice(list("abcd漢字x"), n)) for n in (1, 2, 4, 7, 8, 8, 12)]
    rows, owner = alphabet.rows(words)
    assert len({tuple(r) for r in alphabet.rows(["漢", "字", "x", "y"])[0]}) == 3 and owner[-1] == 6
    size = alphabet.size
    table = rng.normal(size=size**3).astype(np.float32)
    model = toxicity.SubsequenceModel(alphabet, decay, table, 0.25)
    r, c, v = toxicity.explicit(rows, size, decay)
    for n, row in enumerate(rows):
        want = image(row)
        got = {(x // size**2, x // size % size, x % size): w for x, w in zip(c[r == n].tolist(), v[r == n].tolist(), strict=True)}
        assert got.keys() == {tuple(map(int, k)) for k in want} and all(abs(got[tuple(map(int, k))] - w) < 1e-9 for k, w in want.items())
        norm = sum(w * w for w in want.values()) ** 0.5
        assert abs(toxicity.norms(rows[n : n + 1], decay)[0] - norm) < 1e-4 * max(1, norm)
        if norm:
            score = sum(w * table[(int(k[0]) * size + int(k[1])) * size + int(k[2])] for k, w in want.items()) / norm + 0.25
            assert abs(model.score_windows(rows[n : n + 1])[0] - score) < 1e-3


def test_op5_brute_force(spark):
    """Over a whole table: every run of 50 words with an earlier place goes in whole, and only lines in runs of 25 words with an earlier place go."""
    from palimpsest.llm import linededup

    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = sorted((r.doc_id, r.text) for r in table.collect() if r.text is not None)
    gone = defaultdict(set)
    for r in linededup.repeated_runs(table).collect():
        gone[r.k] |= set(range(r.first, r.end))
    got, met, must, may, some = rows(q.op5_line_dedup(spark, sf)), {}, defaultdict(set), defaultdict(set), 0
    for d, text in docs:
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n = [len(WORD.findall(x)) for x in lines]
        for least, out, step in ((25, may, 1), (25, may, -1), (50, must, 1)):  # shortest runs from each line on, and up to each line
            for at in range(len(lines)):
                a, b = at, at + 1
                while sum(n[a:b]) < least and (b < len(lines) if step > 0 else a > 0):
                    a, b = (a, b + 1) if step > 0 else (a - 1, b)
                if sum(n[a:b]) >= least and met.setdefault((least, step, hash(tuple(lines[a:b]))), (d, at)) != (d, at):
                    out[d] |= set(range(a, b))
    for d, text in docs:
        assert must[d] <= gone[d] <= may[d], d
        left, removed = linededup.without_lines(text, [(i, i + 1) for i in gone[d]])
        assert (got[d].n_removed, got[d].chars_left, got[d].text_sha256) == (removed, len(left), sha(left))
        some += removed
    assert some and len(got) == table.count()


def test_op7_brute_force(spark, small, docs):
    got = rows(q.op7_simhash(spark, small))
    fps = {}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for d, text in docs:
        words = WORD.findall(text.translate(lower))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[d].fingerprint == f"{fps[d]:016x}"
    up = {d: d for d in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {d: r.component_id for d, r in got.items()} == {d: root(d) for d in ids}


def test_op8_brute_force(spark, small, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    owners = defaultdict(set)
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        words = word.findall((r.text or "").translate(lower))
        for i in range(max(1, len(words) - 7) if words else 0):
            owners[tuple(words[i : i + 8])].add(str(r.item_id))
    got, some = rows(q.op8_decontamination(spark, small)), 0
    for d, text in docs:
        words = word.findall(text.translate(lower))
        hit, items = set(), set()
        for n in {len(w) for w in owners}:
            for i in range(len(words) - n + 1):
                if own := owners.get(tuple(words[i : i + n])):
                    items |= own
                    hit |= set(range(i, i + n))
        some += bool(items)
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(items), len(items) >= 2)
        assert r.items_sha256 == sha(",".join(sorted(items)))
    assert some


def test_op9_brute_force(spark, small):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    last = {}
    for k, p in pages:
        last[p] = max(k, last.get(p, k))
    got = rows(q.op9_zip_warc(spark, small), "page_id")
    assert len(got) == len(pages)
    for k, p in pages:
        kind, to = ("response", None) if last[p] == k else ("revisit", last[p])
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert tuple(got[k])[1:] == (len(p), digest, kind, to)


def base(text):
    out = []
    low = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for m in re.finditer(low + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_op10_base(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got, some = rows(q.op10_secrets(spark, sf)), 0
    for d, text in docs:
        spans = base(text)
        kinds = Counter(s[2] for s in spans)
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        line = [f"{k}:{a}:{b}" for a, _, k, b in spans]
        assert r.base_sha256 == sha(",".join(line))
        assert set(line) <= set(r.spans.split(","))
        some += len(spans)
    assert some


def test_op10_spans_are_brute_force(spark):
    """Token spans of a whole table: what the operator finds is what the rule says of every candidate, judged one by one in plain Python."""
    import public_tokenizers

    from palimpsest.llm import secret_scan as s

    sf = "/root/testdata/sf0.01"
    with open(q.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        encode = s.load_encoder(f.read(), public_tokenizers.PATTERN)
    run = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    got, some = rows(q.op10_secrets(spark, sf)), 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, want, i = r.text or "", [], 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in run:
                j += 1
            if j - i >= 16:
                end = j
                while end < len(text) and end - j < 2 and text[end] == "=":
                    end += 1
                end = end if end == len(text) or text[end] not in run else j
                word = text[i:end]
                whole = sum(c.isalpha() for c in word) and len(word) <= 2.2 * len(encode(word))
                known = re.fullmatch("[0-9a-f]+|[0-9A-F]+", word) and len(word) in s.DIGEST_LENGTHS or s.UUID.fullmatch(word)
                parts = [p for p in re.split("[^A-Za-z0-9]+", word) if p]
                if whole and not known and not all(s._recognised(p, encode) for p in parts):
                    want.append((i, end))
            i = max(j, i + 1)
        found = [tuple(map(int, x.split(":")[1:])) for x in got[r.doc_id].spans.split(",") if x.startswith("token:")]
        assert set(want) <= set(found), (r.doc_id, want, found)
        assert all(any(text[a:b] in text[c:d] for c, d in [(a, b)]) and len(text[a:b]) <= 2.2 * len(encode(text[a:b])) for a, b in found)
        some += len(found)
    assert some


def test_op10_long_runs_end():
    import time

    import public_tokenizers

    from palimpsest.llm import secret_scan as s

    with open(q.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        encode = s.load_encoder(f.read(), public_tokenizers.PATTERN)
    began = time.time()
    for text in ("q" * 10_000 + "1a", "aB" * 5_000 + "1a", "ab" * 5_000 + "_" + "Qx9" * 3_000, "a" * 200_000):
        s.token_spans(text, encode, 2.2)
    assert time.time() - began < 20


def test_op10_tokens(spark):
    import public_tokenizers

    from palimpsest.llm import secret_scan

    with open(q.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        encode = secret_scan.load_encoder(f.read(), public_tokenizers.PATTERN)
    found = lambda text: [text[a:b] for a, _, b in secret_scan.token_spans(text, encode, 2.2)]
    key = "ghp_x7Qz19vLk2Wd8RtYb3NcMf5"
    assert found(f"use {key} now") == [key] and found(f"k={key}") == [key]
    assert found("internationalisation get_user_by_name_2 CamelCaseIdentifierNames2") == []
    assert found("d41d8cd98f00b204e9800998ecf8427e 123e4567-e89b-12d3-a456-426614174000") == []


def test_op10_token_recall():
    import random
    import string

    import public_tokenizers

    from palimpsest.llm import secret_scan

    with open(q.vocabulary("byte_bpe_50k.tiktoken"), "rb") as f:
        encode = secret_scan.load_encoder(f.read(), public_tokenizers.PATTERN)
    r, base62 = random.Random(5), string.ascii_letters + string.digits
    for before, letters, n in (("", string.ascii_letters, 24), ("", string.ascii_lowercase, 32), ("", base62, 16), ("authorization-header-value-", base62, 20), ("com/static/images/customers/downloads/", base62, 20)):
        texts = [f"use {before}{''.join(r.choices(letters, k=n))} now" for _ in range(200)]
        assert np.mean([any(b == len(t) - 4 for _, _, b in secret_scan.token_spans(t, encode, 2.2)) for t in texts]) >= 0.99
    clean = "com/static/images/customers/downloads/index authorization-header-value-2 commits d41d8cd98f00b204e9800998ecf8427e7a6b5c4d internationalisation"
    assert secret_scan.token_spans(clean, encode, 2.2) == []
