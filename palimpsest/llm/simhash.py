"""SimHash fingerprints, and exact pairs within a Hamming distance by vantage-point trees.

A shard holds the fingerprints that share a key, and each has several keys, so that no pair within the radius is apart in all of
them: blocks of bits where the radius is small (of radius + 1 blocks one is equal), bands of least hashes where
it is wide. In a shard a vantage-point tree parts the fingerprints by their distance from a
vantage point, and a query goes down both sides where the triangle inequality excludes neither, down to small blocks, in which distances
are computed. A shard with very many members is dealt out in chunks, each two of which meet in a task of their own.
What a task finds is reduced to a spanning forest before it leaves it, unless its
links are still to be tested: then all of them leave it, in bundles with few texts, and only tested ones are reduced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.textkit import LOWER, Words, annotate, gather, materialise, raw, release, segment_sums, sized

BLOCK = 512
#: Members of a shard that a task compares with as many others at most.
CHUNK = 1 << 15
#: Members that a shard of blocks of bits has if fingerprints are spread evenly, about.
SHARD = 1 << 10
#: Bands of least hashes and hashes in each; two sets of similarity 0.8 agree in no band once in 23,000 times.
BANDS, ROWS = 14, 3
#: Shards in chunks that are broadcast by name at most.
FEW = 1 << 20
#: Shingles of the texts of one bundle of candidates at most (a pair of longer texts is one bundle).
BUNDLE = 1 << 21


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each run of `size` words joined by spaces, and the texts' bounds among them; a shorter text is one run."""
    text, starts, ends = words.joined()
    n_words = np.diff(words.bounds)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    last = np.minimum(first + size - 1, np.repeat(words.bounds[1:] - 1, count))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(text[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]
    return np.array(hashes, np.uint64), bounds


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the bits set in over half its hashes; 0 for none."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    low, step = 0, 1 << 18
    while low < len(out):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + step, side="right")) - 1)
        part = hashes[bounds[low] : bounds[high]]
        at = bounds[low : high + 1] - bounds[low]
        some = np.flatnonzero(np.diff(at))
        if len(some):
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
            over = 2 * counts > np.diff(at)[some][:, None]
            out[low + some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
        low = high
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """Key and fingerprint (long, the same 64 bits) of every row; A-Z count as lower case, a null text has no words and gets 0."""

    def make():
        def kernel(column: pa.Array) -> list:
            data, offsets = raw(column)
            hashes, bounds = shingle_hashes(Words(LOWER[data], offsets), shingle)
            return [pa.array(majority(hashes, bounds).view(np.int64))]

        return kernel

    return annotate(docs, [key], text, make, [("fp", "bigint")])


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits; a fingerprint's 64-bit words lie along the first axis."""
    out = np.bitwise_count(x[0] ^ y[0])
    for a, b in zip(x[1:], y[1:], strict=True):
        out = out + np.bitwise_count(a ^ b)
    return out


class Forest:
    """Union by smallest number."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def copy(self) -> Forest:
        out = Forest(0)
        out.up = self.up.copy()
        return out

    def settle(self) -> np.ndarray:
        while True:
            new = self.up[self.up]
            if np.array_equal(new, self.up):
                return new
            self.up = new

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joins a[i] with b[i] for all i, earlier pairs first, in rounds over whole arrays; returns the pairs that joined something."""
        used = []
        at = np.arange(len(a))
        while len(at):
            root = self.settle()
            x, y = root[a[at]], root[b[at]]
            apart = x != y
            at, x, y = at[apart], x[apart], y[apart]
            if not len(at):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            high, first = np.unique(high, return_index=True)
            self.up[high] = low[first]
            used.append(at[first])
        return np.concatenate(used) if used else np.zeros(0, np.int64)


def near_pairs(homes: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of queries and homes within the radius and their distances, block by block and nearer ones of a block first, by a tree over the homes."""
    stack = [(np.arange(homes.shape[1]), np.arange(queries.shape[1]), 0)]
    while stack:
        h, q, depth = stack.pop()
        if not len(h) or not len(q):
            continue
        if len(h) > BLOCK and depth < 40:
            point = homes[:, h[(len(h) * 7919 + depth * 104729) % len(h)], None]
            dh = distance(homes[:, h], point).astype(np.int64)
            split = int(np.median(dh))
            inner = dh <= split
            if 0 < inner.sum() < len(h):
                dq = distance(queries[:, q], point).astype(np.int64)
                stack.append((h[inner], q[dq - radius <= split], depth + 1))
                stack.append((h[~inner], q[dq + radius > split], depth + 1))
                continue
        for low in range(0, len(h), BLOCK):
            block = homes[:, None, h[low : low + BLOCK]]
            step = max(1, (1 << 21) // block.shape[2])
            for lo in range(0, len(q), step):
                apart = distance(queries[:, q[lo : lo + step], None], block)
                a, b = np.nonzero(apart <= radius)
                if len(a):
                    d = apart[a, b]
                    order = np.argsort(d, kind="stable")
                    yield q[lo + a[order]], h[low + b[order]], d[order]


def shard_edges(homes: np.ndarray, home_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of linked queries and homes: a spanning forest of the links within the radius, the same in whatever order these come."""
    by_home, by_query = np.argsort(home_ids, kind="stable"), np.argsort(query_ids, kind="stable")
    homes, home_ids, queries, query_ids = homes[:, by_home], home_ids[by_home], queries[:, by_query], query_ids[by_query]
    nodes = np.unique(np.concatenate([home_ids, query_ids]))
    of_home, of_query = np.searchsorted(nodes, home_ids), np.searchsorted(nodes, query_ids)
    left, right, forest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], Forest(len(nodes))
    for q, h, _ in near_pairs(homes, queries, radius):
        used = forest.join(of_query[q], of_home[h])
        left.append(of_query[q[used]])
        right.append(of_home[h[used]])
    return nodes[np.concatenate(left)], nodes[np.concatenate(right)]


def block_masks(n: int, radius: int) -> list[int]:
    """Masks of bits, one of which two 64-bit fingerprints within the radius agree in; a mask's values part n evenly spread ones in shards of about SHARD."""
    for chosen in (1, 2, 3):
        blocks = radius + chosen
        most = 64 // blocks
        if n >> chosen * most <= CHUNK:
            break
    width = min(most, -(-max(0, int(np.ceil(np.log2(max(n, 1) / SHARD)))) // chosen))
    if not width:
        return [0]
    at = [i * 64 // blocks for i in range(blocks)]
    return [sum(((1 << width) - 1) << at[i] for i in some) for some in combinations(range(blocks), chosen)]


def dealt(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows (key, id, others) as (task, far, id, others), the rows of a task together and in order.

    A key with at most `chunk` rows is a task. One with more is cut into chunks by hashes of the ids; each chunk is a task by itself, and each
    two chunks are one, in which the rows of the second are far.
    """
    others = [c for c in rows.columns if c not in ("key", "id")]
    big = materialise(rows.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("bigint").alias("cuts")), "big")
    n = big.count()
    if n:
        own = rows.join(F.broadcast(big) if n <= FEW else big, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1).cast("bigint")))
        own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.col("cuts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
        task = F.when(F.col("cuts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
        out = own.select(task.alias("task"), (F.col("part") > F.col("other")).alias("far"), "id", *others)
    else:
        out = rows.select(F.col("key").alias("task"), F.lit(False).alias("far"), "id", *others)
    return out.repartition(sized(rows.sparkSession), "task").sortWithinPartitions("task", "far", "id")


def _numbers(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """The columns from `first` on as unsigned words by rows."""
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(first, batch.num_columns)])


def _tasks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tasks, far flags, ids and words of runs of whole tasks."""
    held = None
    for batch in batches:
        now = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), _numbers(batch, 3)
        held = now if held is None else tuple(np.concatenate(x, axis=-1) for x in zip(held, now, strict=True))
        if len(held[0]):
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield tuple(x[..., :last] for x in held)
                held = tuple(x[..., last:] for x in held)
    if held is not None and len(held[0]):
        yield held


SMALL = 8


def small_pairs(task: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and distances of the pairs within the radius in tasks of few rows, which stand together."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, SMALL):
        at = np.flatnonzero(task[k:] == task[:-k])
        left.append(at)
        right.append(at + k)
    a, b = np.concatenate(left), np.concatenate(right)
    d = distance(words[:, a], words[:, b])
    near = d <= radius
    return a[near], b[near], d[near]


def _split(task: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Positions of the rows in small tasks that have company, and homes' and queries' positions of each other task."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
    size = np.diff(cut)
    some_far = np.add.reduceat(far.astype(np.int64), cut[:-1]) > 0
    few = (size > 1) & (size <= SMALL) & ~some_far
    large = []
    for i in np.flatnonzero((size > 1) & ~few).tolist():
        at = np.arange(cut[i], cut[i + 1])
        large.append((at[~far[at]], at[far[at]]) if some_far[i] else (at, at))
    return gather(cut[:-1][few], size[few]), large


def fingerprint_edges(fps: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between ids of fingerprints that connect what all pairs within the radius connect.

    fps has an id and a 64-bit fingerprint fp (long each), distinct both.
    """
    masks = block_masks(fps.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])
    rows = dealt(fps.select(F.explode(keys).alias("key"), "id", "fp"), chunk)

    def run(batches):
        for task, far, ids, words in _tasks(batches):
            few, large = _split(task, far)
            a, b, _ = small_pairs(task[few], words[:, few], radius)
            found = [(ids[few[a]], ids[few[b]])]
            found += [shard_edges(words[:, h], ids[h], words[:, q], ids[q], radius) for h, q in large]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])
        release()

    return rows.mapInArrow(run, "a long, b long")


def least_hashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BANDS 32-bit numbers of each text, packed in pairs; each is made of the least of a text's hashes under ROWS orders. 0 for a text without any."""
    n, some = len(bounds) - 1, np.flatnonzero(np.diff(bounds))
    marks = np.zeros((n, BANDS), np.uint32)
    if len(some):
        at = bounds[:-1][some]
        for band in range(BANDS):
            made = np.zeros(len(some), np.uint64)
            for row in range(ROWS):
                odd = mixed(np.array([band * ROWS + row + 1], np.uint64)) | np.uint64(1)
                made = mixed(made + np.minimum.reduceat(hashes * odd, at))
            marks[some, band] = (made >> np.uint64(32)).astype(np.uint32)
    return marks.view(np.uint64)


def shard_bundles(homes: np.ndarray, home_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, limits: list[int], similarity: float, most: int = BUNDLE) -> Iterator[np.ndarray]:
    """All pairs within the last limit, in bundles (ids, ids and number of the limit, a row each) whose texts have few shingles.

    Rows of homes and queries: two words of a fingerprint, the text's number of shingles, the shard's band, the packed marks of all bands. Pairs whose
    numbers alone rule the similarity out are left out, and those that agree in an earlier band, as they meet there.
    """
    own = np.isin(query_ids, home_ids)  # such a pair is met from either side
    for q, h, d in near_pairs(homes[:2], queries[:2], limits[-1]):
        some = np.flatnonzero(~own[q] | (query_ids[q] < home_ids[h]))
        some = some[_first_meeting(queries, q[some], homes, h[some], similarity)]
        yield from bundles_of(queries, query_ids, q[some], homes, home_ids, h[some], np.searchsorted(limits, d[some]), most)


def _first_meeting(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Positions of the pairs x[a], y[b] whose sizes allow the similarity and which agree in no band before this one."""
    s, t = x[2, a].astype(np.int64), y[2, b].astype(np.int64)
    at = np.flatnonzero(np.minimum(s, t) >= similarity * np.maximum(s, t))
    keep = np.ones(len(at), bool)
    band = x[3, a[at]].astype(np.int64)
    for k in range(int(band.max(initial=0))):
        mine, theirs = (w[4 + k // 2, i[at]] >> np.uint64(32 * (k % 2)) & np.uint64(0xFFFFFFFF) for w, i in ((x, a), (y, b)))
        keep &= (band <= k) | (mine != theirs)
    return at[keep]


def bundles_of(queries, query_ids, q, homes, home_ids, h, limit, most: int) -> Iterator[np.ndarray]:
    """The pairs in bundles whose texts have at most so many shingles, if a bundle has more than one pair."""
    size_h, size_q = homes[2].astype(np.int64), queries[2].astype(np.int64)
    stack = [np.arange(len(q))]
    while stack:
        at = stack.pop()
        if not len(at):
            continue
        left, right = np.unique(q[at]), np.unique(h[at])
        heavy = size_q[left].sum(), size_h[right].sum()
        if sum(heavy) > most and len(at) > 1:
            side = q[at] if len(right) == 1 or len(left) > 1 and heavy[0] >= heavy[1] else h[at]
            each = np.unique(side)
            low = side < each[len(each) // 2]
            stack += [at[low], at[~low]]
        else:
            yield np.stack([query_ids[q[at]], home_ids[h[at]], limit[at]])


def candidate_bundles(contents: DataFrame, limits: list[int], similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Rows (bundle, pairs, members) of pairs of ids whose fingerprints lie within the last limit and which agree in a band: a number, the bytes of the pairs and the ids in them.

    contents has an id (long, distinct), the words fp and fp2 of a fingerprint, a number of shingles (size) and the packed marks (see least_hashes).
    """
    band = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BANDS - 1).cast("bigint"))).alias("band")
    marks = [F.get("marks", F.lit(i)).alias(f"m{i}") for i in range(BANDS // 2)]
    key = F.expr("shiftrightunsigned(marks[int(band div 2)], int(32 * (band % 2))) & 4294967295L | shiftleft(band, 32)")
    rows = contents.where("size > 0").select("id", "fp", "fp2", "size", "marks", band).select(key.alias("key"), "id", "fp", "fp2", "size", "band", *marks)
    rows = dealt(rows, chunk)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40

        def found():
            for task, far, ids, words in _tasks(batches):
                few, large = _split(task, far)
                own = words[:, few]
                a, b, d = small_pairs(task[few], own[:2], limits[-1])
                some = _first_meeting(own, a, own, b, similarity)
                yield from bundles_of(own, ids[few], a[some], own, ids[few], b[some], np.searchsorted(limits, d[some]), BUNDLE)
                for h, q in large:
                    yield from shard_bundles(words[:, h], ids[h], words[:, q], ids[q], limits, similarity)

        for pairs in found():
            members = pa.array([np.unique(pairs[:2])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pairs.astype(np.int64).tobytes()]), members], names=["bundle", "pairs", "members"])
            number += 1
        release()

    return rows.mapInArrow(run, "bundle long, pairs binary, members array<long>")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Key, fp and component (smallest key reachable over links) of every row.

    Fingerprints that differ in at most `radius` bits link their rows; equal ones do too, the
    zero fingerprints of texts without words included. Rows with equal fingerprints are one node
    of the graph, so copies aren't paired. Repeated rows share their component; a null key is never
    the smallest (only null keys: null). An empty table gives no rows.
    """
    marked = materialise(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    found = components(fingerprint_edges(nodes.select(F.col("fp").alias("id"), "fp"), radius))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = rooted.join(least, "root").select("fp", "component")
    return marked.join(by_fp, "fp").select(key, "fp", "component")


def mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits made of each number's."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes without repeats, and their bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(bounds)))


def contents_kernel(shingle: int):
    """128-bit fingerprint (two longs) of a text's set of shingles, a hash of its words, the set's size, and its marks (see least_hashes)."""

    def kernel(column: pa.Array) -> list:
        data, offsets = raw(column)
        words = Words(LOWER[data], offsets)
        hashes, bounds = distinct_hashes(*shingle_hashes(words, shingle))
        text, starts, ends = words.joined()
        at = words.bounds.tolist()
        own = [xxhash.xxh64_intdigest(text[starts[a] : ends[b - 1]] if b > a else b"", 7) for a, b in zip(at, at[1:], strict=False)]
        marks = least_hashes(hashes, bounds).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * marks.shape[1]), pa.array(marks.ravel()))
        return [*[pa.array(x.view(np.int64)) for x in (majority(hashes, bounds), majority(mixed(hashes), bounds), np.array(own, np.uint64), np.diff(bounds))], lists]

    return kernel


def sets_kernel(shingle: int):
    """The bytes of a text's set of shingle hashes."""

    def kernel(column: pa.Array) -> list:
        data, offsets = raw(column)
        hashes, bounds = distinct_hashes(*shingle_hashes(Words(LOWER[data], offsets), shingle))
        return [pa.array([hashes[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())]

    return kernel


def verified_links(pairs: np.ndarray, ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all pairs of at least the Jaccard similarity connect.

    pairs: as of shard_bundles; sets: the distinct hashes of each id. A pair goes without comparison only if links that
    passed already connect its ends.
    """
    order = np.argsort(ids)
    a, b = order[np.searchsorted(ids[order], pairs[:2])]
    size = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mark = np.zeros(len(codes), bool)

    def similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(x), bool)
        by = np.argsort(x, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(x[by])) + 1):
            i = x[group[0]]
            own = codes[start[i] : start[i] + size[i]]
            mark[own] = True
            for low in range(0, len(group), 1024):
                part = group[low : low + 1024]
                n = size[y[part]]
                both = segment_sums(mark[codes[gather(start[y[part]], n)]], np.concatenate([[0], np.cumsum(n)]))
                ok[part] = both >= similarity * (size[i] + n - both)
            mark[own] = False
        return ok

    forest, left, right = Forest(len(ids)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for band in np.unique(pairs[2]):
        todo = np.flatnonzero(pairs[2] == band)
        # A forest of the links first, as it may spare most of the others; in the end whatever is still apart.
        for whole in (False, False, True):
            root = forest.settle()
            todo = todo[root[a[todo]] != root[b[todo]]]
            if not len(todo):
                break
            pick = np.arange(len(todo)) if whole else forest.copy().join(a[todo], b[todo])
            tried = todo[pick]
            good = tried[similar(a[tried], b[tried])]
            used = good[forest.join(a[good], b[good])]
            left.append(ids[a[used]])
            right.append(ids[b[used]])
            todo = np.delete(todo, pick)
    return np.concatenate(left), np.concatenate(right)


def _verify(similarity: float):
    """Links of bundles, from rows (bundle, content, data) in the bundles' order: the pairs, without a content, and the sets of each content."""

    def run(batches):
        now, pairs, ids, sets = None, None, [], []

        def links():
            a, b = verified_links(np.frombuffer(pairs, np.int64).reshape(3, -1), np.array(ids, np.int64), sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for bundle, content, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bundle != now:
                    if now is not None:
                        yield links()
                    now, pairs, ids, sets = bundle, None, [], []
                if content is None:
                    pairs = data
                else:
                    ids.append(content)
                    sets.append(np.frombuffer(data, np.uint64))
        if now is not None:
            yield links()
        release()

    return run


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, limits: tuple[int, ...] = (10, 15, 20, 25, 30, 34), similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near duplicates, the one with the smallest key; all columns stay.

    Two texts are near duplicates if the sets of their runs of `shingle` words have at least the Jaccard similarity; candidates agree in
    a band of least hashes and have 128-bit fingerprints within the last limit (at 0.8 about 19 bits differ, in very few pairs more than 34). similarity
    must be 0.8 at least, as the bands are made for that. Each candidate is
    compared in full, limit by limit, unless links that passed already join its texts. Texts with equal words are one node.
    Groups are what links reach. A null text has no words; texts without words are copies of one
    another. Null keys come after all others. Repeated rows of one document are reduced to one.
    """
    if similarity < 0.8:
        raise ValueError("a similarity of 0.8 or more is needed")
    name, body = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = docs.select(name.alias("k"), F.xxhash64(body).alias("h"), body.alias("t"))
    marked = materialise(annotate(source, ["k", "h"], "t", lambda: contents_kernel(shingle), [("fp", "bigint"), ("fp2", "bigint"), ("content", "bigint"), ("size", "bigint"), ("marks", "array<bigint>")]), "contents")
    first = F.struct(F.col("k").isNull().alias("n"), "k", "h")
    contents = materialise(marked.groupBy("content").agg(F.first("fp").alias("fp"), F.first("fp2").alias("fp2"), F.first("size").alias("size"), F.first("marks").alias("marks"), F.min(first).alias("least")), "nodes")
    bundles = materialise(candidate_bundles(contents.select(F.col("content").alias("id"), "fp", "fp2", "size", "marks"), list(limits), similarity), "bundles")
    members = bundles.select("bundle", F.explode("members").alias("content"))
    wanted = members.select("content").distinct().join(contents, "content").select("content", "least.k", "least.h")
    texts = source.join(wanted.withColumnsRenamed({"k": "wk", "h": "wh"}), F.col("k").eqNullSafe(F.col("wk")) & (F.col("h") == F.col("wh"))).groupBy("content").agg(F.first("t").alias("t"))
    sets = materialise(annotate(texts, ["content"], "t", lambda: sets_kernel(shingle), [("data", "binary")]), "sets")
    given = bundles.select("bundle", F.lit(None).cast("bigint").alias("content"), F.col("pairs").alias("data")).unionByName(members.join(sets, "content"))
    linked = given.repartition(sized(docs.sparkSession), "bundle").sortWithinPartitions("bundle", "content").mapInArrow(_verify(similarity), "a bigint, b bigint")
    found = components(linked)
    rooted = contents.join(found.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    stay = materialise(rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.k", "least.h").withColumnsRenamed({"k": "\x01k", "h": "\x01h"}), "stay")
    kept = docs.join(stay, name.eqNullSafe(F.col("\x01k")) & (F.xxhash64(body) == F.col("\x01h")), "left_semi")
    repeated = marked.groupBy("k", "h").count().where("count > 1").limit(1)
    return kept if repeated.isEmpty() else kept.withColumn("\x01h", F.xxhash64(body)).dropDuplicates([key, "\x01h"]).drop("\x01h")
