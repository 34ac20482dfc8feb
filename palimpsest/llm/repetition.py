"""Quality rules: surface counts, and repetition measured on a suffix array of words.

The suffix array of every text of a batch is built at once by prefix doubling: a suffix's
rank is the head of its group, and only groups of two or more are sorted again. Longest
common prefixes of neighbours come from the ranks of earlier rounds. Neighbours with a
common prefix of at least the least length form the LCP intervals; each suffix in one has a
maximal repeat as long as its larger neighbouring prefix, and the union of these spans is the
repeated part of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkit import ASCII_SPACE, Words, annotate, covered, raw, segment_sums

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHARACTER = np.ones(256, dtype=bool)  # bytes that begin a code point
_CHARACTER[0x80:0xC0] = False


class SuffixRanks:
    """Suffix array of the words of many texts; suffixes of different texts are never compared.

    codes: a number for each word's spelling; bounds: the texts' positions. order is the suffix
    array (by text, then by suffix); at_least(k), k a power of two up to keep_from, tells which
    positions begin k words that the text has elsewhere too.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, keep_from: int = 8):
        n = len(codes)
        self.codes, self.keep_from = codes, keep_from
        sizes = np.diff(bounds)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.stop = np.repeat(bounds[1:], sizes)
        key = self.text.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        active = self._heads(self.order, key[self.order], np.zeros(n, np.int64), rank, slots=np.arange(n))
        self.levels: list[tuple[int, np.ndarray]] = []
        self.repeated = {}
        k = 1
        while True:
            if k == keep_from:
                self.repeated = np.zeros(n, bool)
                self.repeated[self.order[active]] = True
            if k >= keep_from and len(active):
                self.levels.append((k, rank.astype(np.int32)))
            if not len(active):
                if k < keep_from:
                    self.repeated = np.zeros(n, bool)
                break
            at = self.order[active]
            ahead = at + k
            inside = ahead < self.stop[at]
            follow = np.zeros(len(at), np.int64)
            follow[inside] = rank[ahead[inside]] + 1
            head = rank[at]
            key = head * (n + 1) + follow
            by = np.argsort(key, kind="stable")
            self.order[active] = at[by]
            active = self._heads(at[by], key[by], head[by], rank, slots=active)
            k *= 2
        self.rank = rank

    @staticmethod
    def _heads(at, key, _head, rank, slots) -> np.ndarray:
        """Sets the rank of the sorted positions to their group's first slot; returns the slots of groups of two or more."""
        n = len(at)
        if not n:
            return slots
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        group = np.cumsum(first) - 1
        begin = np.flatnonzero(first)
        rank[at] = slots[begin][group]
        size = np.diff(np.append(begin, n))
        return slots[size[group] > 1]

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adjacent suffixes of the array with a common prefix of keep_from words or more, and its length."""
        if not self.levels:
            none = np.zeros(0, np.int64)
            return none, none, none
        rank = self.levels[0][1]
        same = rank[self.order[1:]] == rank[self.order[:-1]]
        a, b = self.order[:-1][same], self.order[1:][same]
        x, y, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k, rank in reversed(self.levels):
            # A smaller power may fit more than once below the largest one.
            for _ in range(2 if k == self.levels[-1][0] else 1):
                ok = (x < self.stop[a]) & (y < self.stop[b])
                ok[ok] = rank[x[ok]] == rank[y[ok]]
                length[ok] += k
                x[ok] += k
                y[ok] += k
        for _ in range(self.keep_from):
            ok = (x < self.stop[a]) & (y < self.stop[b])
            ok[ok] = self.codes[x[ok]] == self.codes[y[ok]]
            length[ok] += 1
            x[ok] += 1
            y[ok] += 1
        return a, b, length


def _starts_of_codepoints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return segment_sums(_CHARACTER[data], offsets)


def quality_kernel(window: int, least: int):
    def kernel(column: pa.Array) -> list:
        data, offsets = raw(column)
        words = Words(data, offsets)
        n_words = np.diff(words.bounds)
        chars = _starts_of_codepoints(data, offsets) - segment_sums(ASCII_SPACE[data], offsets)
        symbols = segment_sums(_SYMBOL[data], offsets)
        dup_lines = np.zeros(len(column), np.int64)
        buffer = data.tobytes()
        at = offsets.tolist()
        for i in range(len(column)):
            lines = [x for x in buffer[at[i] : at[i + 1]].split(b"\n") if x and not x.isspace()]
            dup_lines[i] = len(lines) - len(set(lines))
        ranks = SuffixRanks(words.codes, words.bounds, window)
        begins = np.flatnonzero(ranks.repeated)
        windows = covered(begins, begins + window, len(words))
        a, b, length = ranks.neighbours()
        longest = np.zeros(len(words), np.int64)
        np.maximum.at(longest, a, length)
        np.maximum.at(longest, b, length)
        begins = np.flatnonzero(longest >= least)
        spans = covered(begins, begins + longest[begins], len(words))
        doc_longest = np.zeros(len(column), np.int64)
        np.maximum.at(doc_longest, ranks.text, longest)
        # The union's islands within each text, as word positions.
        edge = np.zeros(len(words), bool)
        edge[words.bounds[:-1][words.bounds[:-1] < len(words)]] = True
        before = np.concatenate([[False], spans[:-1]]) & ~edge
        after = np.concatenate([spans[1:] & ~edge[1:], [False]]) if len(spans) else spans
        first, last = np.flatnonzero(spans & ~before), np.flatnonzero(spans & ~after) + 1
        island = np.searchsorted(first, words.bounds)
        base = np.repeat(words.bounds[:-1], np.diff(island))
        lists = [pa.ListArray.from_arrays(pa.array(island.astype(np.int32)), pa.array((x - base).astype(np.int64))) for x in (first, last)]
        return [
            pa.array(n_words.astype(np.int64)), pa.array(chars), pa.array(symbols), pa.array(dup_lines),
            pa.array(segment_sums(windows, words.bounds)), pa.array(segment_sums(spans, words.bounds)), pa.array(doc_longest), *lists,
        ]

    return kernel


def quality(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 8, least_repeat: int = 16,
    most_covered: float = 0.25, longest_repeat: int = 250, least_words: int = 20, most_window_percent: int = 30,
) -> DataFrame:
    """Surface counts of every row, its repeated spans, and whether it is kept.

    Words lie between ASCII white space. n_repeat_words counts the words inside windows of
    `window` words that the text has twice or more; repeat_words those in maximal repeats of
    least_repeat words or more, repeat_from and repeat_to are their spans' word positions, and
    longest counts the words of the longest repeat of at least `window` words. A row is kept unless
    it fails the base rules, more than most_covered of its words are repeated, or its longest
    repeat exceeds longest_repeat words.

    A null or empty text has no words and fails. Rows are judged alone: repeated rows get
    equal results. Other columns aren't read.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_words", "longest"]
    fields = [*[(n, "bigint") for n in names], ("repeat_from", "array<bigint>"), ("repeat_to", "array<bigint>")]
    out = annotate(docs, [key], text, lambda: quality_kernel(window, least_repeat), fields)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_window_percent * F.col("n_words"))
    good = (F.col("repeat_words") <= most_covered * F.col("n_words")) & (F.col("longest") <= longest_repeat)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
