"""Line dedup by winnowing.

Only lines with a word count. A shingle is the shortest run of lines from a line on with at least `noise`
words, a window the shortest with at least `guarantee` words; in each window the shingle with the smallest hash (the last of equal
ones) is a fingerprint. Two texts that share a run of lines with `guarantee` words share a window, so they choose
a common fingerprint there. A fingerprint's first place (by key, then by hash of the text, then by line) is its source. Every later place is
compared with the source's lines both ways, and what agrees is a repeated run. As the first place may share less than another earlier one,
the windows around a common fingerprint are looked up themselves, too: each that has an earlier place is a repeated run.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkit import annotate, looked_up, materialise

#: Places of one fingerprint in one task of a join at most, about.
SHARE = 512
_H = xxhash.xxh64_intdigest
_MASK = (1 << 63) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def winnow(hashes: list[int], words: list[int], noise: int, guarantee: int) -> list[tuple[int, int, int, int, int]]:
    """(fingerprint, first line, end line) of the shingles selected in a text's lines, and the first lines of the first and the last window that selects it."""
    n = len(hashes)
    shingles: list[tuple[int, int, int]] = []
    end = total = 0
    for i in range(n):
        while end < n and total < noise:
            total += words[end]
            end += 1
        if total < noise:
            break
        # The hash of a run is that of its lines' hashes.
        code = hashes[i] if end == i + 1 else _H(np.array(hashes[i:end], np.uint64).tobytes(), 1)
        shingles.append((code, i, end))
        total -= words[i]
    out: dict[int, tuple[int, int, int, int, int]] = {}
    queue: deque = deque()
    nxt = end = total = 0
    for i in range(n):
        while end < n and total < guarantee:
            total += words[end]
            end += 1
        if total < guarantee:
            break
        while nxt < len(shingles) and shingles[nxt][2] <= end:
            while queue and queue[-1][0] >= shingles[nxt][0]:
                queue.pop()
            queue.append(shingles[nxt])
            nxt += 1
        while queue and queue[0][1] < i:
            queue.popleft()
        if queue:
            at = queue[0][1]
            out[at] = (*queue[0], out[at][3] if at in out else i, i)
        total -= words[i]
    return [out[k] for k in sorted(out)]


def context(hashes: list[int], words: list[int], first: int, end: int, reach: int) -> tuple[int, int]:
    """The lines around [first, end) that hold `reach` words on either side, or all there are."""
    low, total = first, 0
    while low > 0 and total < reach:
        low -= 1
        total += words[low]
    high, total = end, 0
    while high < len(hashes) and total < reach:
        total += words[high]
        high += 1
    return low, high


def worded_lines(text: bytes) -> tuple[list[int], list[bytes]]:
    """Numbers and bytes of the lines that have a word."""
    lines = text.split(b"\n")
    at = [i for i, x in enumerate(lines) if x and not x.isspace()]
    return at, [lines[i] for i in at]


def windows(words: np.ndarray, since: int, until: int, guarantee: int) -> list[tuple[int, int]]:
    """The runs (first line, end line) from the lines `since` to `until` on that have `guarantee` words and lose that without their last or without their first line.

    Every line of a run with `guarantee` words is in one of these that lies in the run.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    out = []
    for i in range(since, until + 1):
        low = int(np.searchsorted(total, total[i] + guarantee))
        high = int(np.searchsorted(total, total[i + 1] + guarantee))
        out += [(i, end) for end in range(low, min(max(low + 1, high), len(total)))]
    return out


PLACES = [("places", "array<struct<fp: bigint, at: int, low: int, since: int, until: int, lines: binary, words: binary>>")]
_PLACE = pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("since", pa.int32()), ("until", pa.int32()), ("lines", pa.binary()), ("words", pa.binary())])


def places_kernel(noise: int, guarantee: int):
    def kernel(column: pa.Array) -> list:
        sizes, fps, ats, lows, sinces, untils, lines, counts = [0], [], [], [], [], [], [], []
        for text in column.cast(pa.binary()).to_pylist():
            _, own = worded_lines(text)
            words = [len(x.split()) for x in own]
            if sum(words) >= guarantee:
                hashes = [_H(x) for x in own]
                code, count = np.array(hashes, np.uint64), np.minimum(words, guarantee).astype(np.uint32)
                for fp, first, end, since, until in winnow(hashes, words, noise, guarantee):
                    low, high = context(hashes, words, first, end, guarantee)
                    fps.append(_signed(fp))
                    ats.append(first)
                    lows.append(low)
                    sinces.append(since)
                    untils.append(until)
                    lines.append(code[low:high].tobytes())
                    counts.append(count[low:high].tobytes())
            sizes.append(len(fps))
        flat = pa.StructArray.from_arrays(
            [pa.array(fps, pa.int64()), *[pa.array(x, pa.int32()) for x in (ats, lows, sinces, untils)], pa.array(lines, pa.binary()), pa.array(counts, pa.binary())], fields=list(_PLACE)
        )
        return [pa.ListArray.from_arrays(pa.array(np.array(sizes, np.int32)), flat)]

    return kernel


def agreement(mine: np.ndarray, at: int, theirs: np.ndarray, source_at: int) -> tuple[int, int]:
    """How many lines agree before `at`, and from it on, with the source's lines at the same distances."""
    back = min(at, source_at)
    a, b = mine[at - back : at][::-1], theirs[source_at - back : source_at][::-1]
    off = np.flatnonzero(a != b)
    before = int(off[0]) if len(off) else back
    ahead = min(len(mine) - at, len(theirs) - source_at)
    off = np.flatnonzero(mine[at : at + ahead] != theirs[source_at : source_at + ahead])
    return before, int(off[0]) if len(off) else ahead


def _extend(batches):
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        at, low, s_at, s_low = (cols[n].to_numpy(zero_copy_only=False) for n in ("at", "low", "s_at", "s_low"))
        mine, theirs = cols["lines"].to_pylist(), cols["s_lines"].to_pylist()
        first, end = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        for i in range(len(at)):
            before, ahead = agreement(np.frombuffer(mine[i], np.uint64), at[i] - low[i], np.frombuffer(theirs[i], np.uint64), s_at[i] - s_low[i])
            first[i], end[i] = at[i] - before, at[i] + ahead
        keep = pa.array(end > first)
        yield pa.RecordBatch.from_arrays([cols["k"], cols["h"], pa.array(first), pa.array(end)], names=["k", "h", "first", "end"]).filter(keep)


def _windows(guarantee: int):
    """The windows (hash, first line, end line) of each place."""

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            low, since, until = (cols[n].to_numpy(zero_copy_only=False) for n in ("low", "since", "until"))
            row, codes, first, end = [], [], [], []
            for i, (lines, words) in enumerate(zip(cols["lines"].to_pylist(), cols["words"].to_pylist(), strict=True)):
                for a, b in windows(np.frombuffer(words, np.uint32).astype(np.int64), since[i] - low[i], until[i] - low[i], guarantee):
                    row.append(i)
                    codes.append(_signed(_H(lines[8 * a : 8 * b], 2)))
                    first.append(low[i] + a)
                    end.append(low[i] + b)
            at = pa.array(row, pa.int64())
            made = [cols["k"].take(at), cols["h"].take(at), pa.array(codes, pa.int64()), pa.array(first, pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, names=["k", "h", "code", "first", "end"])

    return run


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = 25, guarantee: int = 50) -> DataFrame:
    """k (the key), h (hash of the text) and runs of worded lines [first, end) that repeat earlier ones.

    Lines are numbered from 0 without those that have no word. Any run of lines with `guarantee` words that a
    text shares with an earlier place is found in whole, and no run below `noise` words is. Rows with equal key and text count as one.
    A run agrees with its source at most `guarantee` words before and after each fingerprint; neighbouring
    fingerprints are nearer than that.
    """
    source = docs.select(F.col(f"`{key}`").alias("k"), text_hash(text).alias("h"), F.col(f"`{text}`").alias("t"))
    keyed = annotate(source, ["k", "h"], "t", lambda: places_kernel(noise, guarantee), PLACES)
    flat = materialise(keyed.select("k", "h", F.explode("places").alias("p")).select("k", "h", "p.*"), "places")
    order = F.struct(F.col("k").isNull().alias("n"), "k", "h", "at")
    common = materialise(flat.groupBy("fp").agg(F.count("*").alias("c"), F.min(order).alias("s")).where("c > 1"), "common")
    hits = materialise(looked_up(flat, common, "fp", ["k", "h", "at"], SHARE), "hits")
    mine = order.eqNullSafe(F.col("s"))
    source = hits.where(mine).groupBy("fp").agg(F.first(F.struct(F.col("at").alias("s_at"), F.col("low").alias("s_low"), F.col("lines").alias("s_lines"))).alias("x"))
    source = common.select("fp", "c").join(source.select("fp", "x.*"), "fp")
    kind = _type(docs, key)
    pairs = looked_up(hits.where(~mine).drop("s", "c"), source, "fp", ["k", "h", "at"], SHARE)
    found = pairs.select("k", "h", "at", "low", "lines", "s_at", "s_low", "s_lines").mapInArrow(_extend, f"k {kind}, h bigint, first int, end int")
    held = materialise(hits.select("k", "h", "low", "since", "until", "lines", "words").mapInArrow(_windows(guarantee), f"k {kind}, h bigint, code bigint, first int, end int"), "windows")
    order = F.struct(F.col("k").isNull().alias("n"), "k", "h", "first")
    common = held.groupBy("code").agg(F.count("*").alias("c"), F.min(order).alias("s")).where("c > 1")
    found = found.unionByName(looked_up(held, common, "code", ["k", "h", "first"], SHARE).where(~order.eqNullSafe(F.col("s"))).select("k", "h", "first", "end"))
    # Of a text's runs from one line on, the longest.
    return found.groupBy("k", "h", "first").agg(F.max("end").alias("end"))


def text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def _type(df: DataFrame, column: str) -> str:
    return df.select(F.col(f"`{column}`")).schema[0].dataType.simpleString()


def without_lines(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the worded lines in the runs, and how many lines these are; blank lines stay."""
    lines = text.split("\n")
    dead: set[int] = set()
    for a, b in runs:
        dead.update(range(a, b))
    out, k = [], 0
    for x in lines:
        b = x.encode()
        if b and not b.isspace():
            k += 1
            if k - 1 in dead:
                continue
        out.append(x)
    return "\n".join(out), len(lines) - len(out)


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = 25, guarantee: int = 50, removed: str = "\x01removed") -> DataFrame:
    """docs with the later repeated runs of lines taken out of the text, and a column with the number of lines taken out.

    Every row and all columns stay. A null text stays null; a text of nothing but repeated lines becomes what
    blank lines it has. The first place of a run stays, and rows with equal key and text are one text, so repeated rows keep theirs. removed must not be a column's name.
    A fingerprint that a third of all texts have is counted and its first place found by aggregations that combine before their shuffles; its
    places are then dealt out to several tasks.
    """
    if removed in docs.columns:
        raise ValueError(f"{removed} is a column already")
    runs = repeated_runs(docs, key, text, noise, guarantee)
    by_text = runs.groupBy("k", "h").agg(F.collect_list(F.struct("first", "end")).alias("\x01runs")).withColumnsRenamed({"k": "\x01k", "h": "\x01h"})
    same = F.col(f"`{key}`").eqNullSafe(F.col("\x01k")) & (text_hash(text) == F.col("\x01h"))
    joined = docs.join(by_text, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "\x01runs")
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            columns, found = list(batch.columns[:-1]), batch.column(batch.num_columns - 1)
            count = np.zeros(batch.num_rows, np.int64)
            hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                texts = columns[at].to_pylist()
                for i in hit.tolist():
                    if texts[i] is not None:
                        texts[i], count[i] = without_lines(texts[i], [(r["first"], r["end"]) for r in found[i].as_py()])
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count)], names=[*docs_columns, removed])

    docs_columns = list(docs.columns)
    return joined.mapInArrow(run, _with(docs.schema, removed))


def _with(schema, name):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField(name, T.LongType())])
