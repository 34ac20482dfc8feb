"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of consecutive words of the test items. Patterns of one length share a
table: a block is two words (one for patterns of one word); the shift table tells how far the window may
move when a block ends it, blocks in no pattern allow the whole move; blocks that end a
pattern have a bucket of the patterns with that suffix, told apart by their first word
and then compared in full.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkit import LOWER, annotate, covered, materialise, raw, transform_texts

#: Lower case; what isn't a digit, a letter or beyond ASCII becomes a space.
_FOLD = LOWER.copy()
_FOLD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
FOLD = _FOLD.tobytes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class WuManber:
    """Search for equally long sequences of words; each has the numbers of its owners."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m = len(next(iter(patterns)))
        self.b = min(2, self.m)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        self.furthest = self.m - self.b + 1
        for words, owners in patterns.items():
            for end in range(self.b, self.m + 1):
                block = words[end - 2 : end] if self.b == 2 else words[0]
                self.shift[block] = min(self.shift.get(block, self.furthest), self.m - end)
            self.buckets[block][words[0]].append((list(words), owners))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, words: list[bytes], found: list[tuple[int, int, list[int]]]) -> None:
        """Appends (start, end, owners) of each occurrence."""
        get, buckets, m, furthest, n = self.shift.get, self.buckets, self.m, self.furthest, len(words)
        i = m - 1
        if self.b == 2:
            while i < n:
                move = get((words[i - 1], words[i]), furthest)
                if move:
                    i += move
                    continue
                first = i - m + 1
                for pattern, owners in buckets[words[i - 1], words[i]].get(words[first], ()):
                    if words[first : i + 1] == pattern:
                        found.append((first, i + 1, owners))
                i += 1
        else:
            for i, word in enumerate(words):
                if word in buckets:
                    for _, owners in buckets[word][word]:
                        found.append((i, i + 1, owners))


def windows_of(text: str | None, size: int) -> list[tuple[bytes, ...]]:
    """Windows of `size` consecutive words; a shorter text with a word is one window."""
    words = words_of(text)
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def build(items: list[tuple[str, str]], size: int) -> list[WuManber]:
    """One table for each length of window; owners are positions in items."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for k, (_, text) in enumerate(items):
        for w in set(windows_of(text, size)):
            by_length[len(w)][w].append(k)
    return [WuManber(by_length[m]) for m in sorted(by_length)]


def hits_kernel(blocks, size: int):
    """blocks: broadcasts of lists of items, few enough that a task holds the tables of all."""

    def make():
        kept = [(b.value, build(b.value, size)) for b in blocks]

        def kernel(column: pa.Array) -> list:
            data, offsets = raw(column)
            folded, at = data.tobytes().translate(FOLD), offsets.tolist()
            n_words, n_hit, sizes, names, froms, tos, span_sizes = [], [], [0], [], [], [], [0]
            every: dict[int, list] = {}
            owned: dict[int, set] = {}
            counts = [0] * len(column)
            for items, tables in kept:
                for i in range(len(column)):
                    words = folded[at[i] : at[i + 1]].split()
                    counts[i] = len(words)
                    found: list = []
                    for table in tables:
                        table.search(words, found)
                    if found:
                        every.setdefault(i, []).extend((a, b) for a, b, _ in found)
                        owned.setdefault(i, set()).update(items[o][0] for _, _, own in found for o in own)
            for i, n in enumerate(counts):
                hit, found, owners = 0, every.get(i), owned.get(i, ())
                if found:
                    mask = covered(np.array([f[0] for f in found]), np.array([f[1] for f in found]), n)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    froms += edges[::2].tolist()
                    tos += edges[1::2].tolist()
                    hit = int(mask.sum())
                n_words.append(n)
                n_hit.append(hit)
                names += sorted(owners)
                sizes.append(len(names))
                span_sizes.append(len(froms))
            lists = lambda offs, values, kind: pa.ListArray.from_arrays(pa.array(np.array(offs, np.int32)), pa.array(values, kind))
            return [
                pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), lists(sizes, names, pa.string()),
                lists(span_sizes, froms, pa.int64()), lists(span_sizes, tos, pa.int64()),
            ]

        return kernel

    return make


FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("items", "array<string>"), ("hit_from", "array<bigint>"), ("hit_to", "array<bigint>")]


#: Blocks of items whose tables a task holds at once.
BLOCKS = 4


def item_groups(items: DataFrame, item_key: str, item_text: str, block_bytes: int) -> Iterator[list[list[tuple[str, str]]]]:
    """The test items in groups of at most BLOCKS blocks of bounded size, for one broadcast each.

    Items without a word have no window and are left out. Items are streamed to the driver one
    partition at a time, and one group is held there at once, however large the test set is.
    """
    rows = items.select(F.col(f"`{item_key}`").cast("string").alias("k"), F.col(f"`{item_text}`").cast("string").alias("t")).where("k is not null and t is not null")
    group: list[list[tuple[str, str]]] = [[]]
    size = 0
    for k, t in rows.toLocalIterator():
        if size and size + len(t) > block_bytes:
            if len(group) == BLOCKS:
                yield group
                group = []
            group.append([])
            size = 0
        group[-1].append((k, t))
        size += len(t)
    yield group


def in_one_pass(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, block_bytes: int):
    """The broadcasts of the only group of items, or None and all groups where there are more."""
    groups = item_groups(items, item_key, item_text, block_bytes)
    first, second = next(groups), next(groups, None)
    context = docs.sparkSession.sparkContext
    if second is None:
        return [context.broadcast(b) for b in first], None
    return None, chain([first, second], groups)


def in_passes(docs: DataFrame, keys: list[str], text: str, groups, window: int) -> DataFrame:
    """As annotate() with the fields of hits_kernel(), a pass over the texts for each group of items; only rows with hits are then gathered, by the text's hash.

    Equal texts have equal hits, so a text's hash and length stand for it.
    """
    context = docs.sparkSession.sparkContext
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    marked = docs.select(*[F.col(f"`{k}`") for k in keys], F.sha2(body, 256).alias("\x01h"), body.alias("\x01t"))
    found = None
    for group in groups:
        blocks = [context.broadcast(b) for b in group]
        made = materialise(annotate(marked, ["\x01h"], "\x01t", hits_kernel(blocks, window), FIELDS).where("size(items) > 0").dropDuplicates(["\x01h"]), "hits")
        found = made if found is None else found.unionByName(made)
        for b in blocks:
            b.unpersist()
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_from", "hit_to"))))
    every = found.groupBy("\x01h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), spans.alias("s"))
    # Spans that touch or overlap become one.
    start = F.lit(None).cast("struct<done: array<struct<hit_from: bigint, hit_to: bigint>>, now: struct<hit_from: bigint, hit_to: bigint>>")

    def step(state, x):
        now = state["now"]
        apart = F.struct(F.concat(state["done"], F.array(now)).alias("done"), x.alias("now"))
        longer = F.struct(now["hit_from"].alias("hit_from"), F.greatest(now["hit_to"], x["hit_to"]).alias("hit_to"))
        fresh = F.struct(F.array().cast("array<struct<hit_from: bigint, hit_to: bigint>>").alias("done"), x.alias("now"))
        return F.when(state.isNull(), fresh).when(x["hit_from"] > now["hit_to"], apart).otherwise(F.struct(state["done"].alias("done"), longer.alias("now")))

    merged = F.aggregate("s", start, step, lambda s: F.concat(s["done"], F.array(s["now"])))
    every = every.select("\x01h", "items", merged.alias("m"))
    count = annotate(marked, [*keys, "\x01h"], "\x01t", words_kernel, [("n_words", "bigint")])
    none = lambda kind: F.array().cast(f"array<{kind}>")
    joined = count.join(every, "\x01h", "left")
    part = lambda name: F.coalesce(F.transform("m", lambda x: x[name]), none("bigint")).alias(name)
    hit = F.aggregate(F.coalesce(F.transform("m", lambda x: x["hit_to"] - x["hit_from"]), none("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return joined.select(*[F.col(f"`{k}`") for k in keys], "n_words", hit.alias("n_hit"), F.coalesce("items", none("string")).alias("items"), part("hit_from"), part("hit_to"))


def words_kernel():
    return lambda column: [pa.array([len(words_of(t)) for t in column.to_pylist()], pa.int64())]


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = 8, block_bytes: int = 16 << 20,
) -> DataFrame:
    """Each row's count of words, words inside occurring windows, the items that own these (sorted), and the hit spans.

    Words are maximal runs of digits, letters and characters beyond ASCII, A-Z in lower case. Test
    items come in blocks of at most block_bytes (a longer item is a block), each a broadcast of its
    own; BLOCKS of them are searched in one pass over the texts, more in further passes. Null texts have no words, empty ones neither; repeated items own the same windows, repeated rows have equal hits;
    an empty test set hits nothing, an empty table gives no rows. Other columns aren't read.
    """
    blocks, groups = in_one_pass(docs, items, item_key, item_text, block_bytes)
    if groups is not None:
        return in_passes(docs, [key], text, groups, window)
    return annotate(docs, [key], text, hits_kernel(blocks, window), FIELDS)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 8, most_items: int = 0,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of docs, all columns, in which windows of at most most_items items occur (0: none).

    Eight words in a row that a test item has are the rule's whole evidence, however long the text is. Null and empty texts stay, repeated rows stay or go together; an
    empty test set drops nothing.
    """
    blocks, groups = in_one_pass(docs, items, item_key, item_text, block_bytes)
    if groups is not None:
        marked = docs.withColumn("\x01d", F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))
        bad = in_passes(marked, ["\x01d"], text, groups, window).where(F.size("items") > most_items).select("\x01d").distinct()
        return marked.join(bad, "\x01d", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

    def make():
        kernel = hits_kernel(blocks, window)()

        def run(batch: pa.RecordBatch, column: pa.Array) -> pa.RecordBatch:
            return batch.filter(pc.less_equal(pc.list_value_length(kernel(column)[2]), most_items))

        return run

    return transform_texts(docs, text, make)
