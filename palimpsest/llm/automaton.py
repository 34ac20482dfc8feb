"""BPE as a deterministic automaton over tokens: encoding by arcs, decoding by arc labels.

Construction. The automaton begins with one state that loops on every base symbol. Each
merge (u, v) -> w, in order, applies a merge gadget: the target of the u arcs is copied, the
copy loses its v arc, every u arc is led to the copy, and each state with a u arc gets a w arc
to the old target of v. If the target of u has no v arc, the pair can't stand side by side
and the merge never fires. A gadget leaves all arcs of a label at one target, so a state is
known by the label that entered it. The copies are kept as records (label, lost label, step),
and an arc is there unless a copy in the source state's ancestry lost the label, or an
ancestor label it was derived from, while both were current. Arcs found are kept in a
transition table.

The accepted path of a word is unique and equals the result of applying merges by rank.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.textkit import Words, annotate, gather, raw

#: Stands for the end-of-word suffix, so that it can't be taken for the text's own characters.
END = ""


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """labels: id of each arc label (END for the end-of-word suffix); merges: pairs of labels in rank order."""

    def __init__(self, labels: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = labels
        self.longest = max(map(len, labels), default=1)
        #: The length of the longest label that begins with four given symbols.
        self.reach: dict[str, int] = {}
        for x in labels:
            if len(x) > 3 and len(x) > self.reach.get(x[:4], 0):
                self.reach[x[:4]] = len(x)
        self.left: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        self.lost: dict[int, int] = {}
        self._spine_l: dict[int, list[tuple[int, int]]] = {}
        self._spine_r: dict[int, list[tuple[int, int]]] = {}
        self._arcs: dict[int, bool] = {}
        for step, (a, b) in enumerate(merges, 1):
            self._gadget(step, labels[a], labels[b], labels[a + b])
        self._arcs = {}

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        if w in self.born:
            raise ValueError("two merges make one label")
        if self._has(u, v):
            self.lost[u << 32 | v] = step
        self.born[w], self.left[w] = step, (u, v)

    def _spine(self, label: int, side: int) -> list[tuple[int, int]]:
        """The labels a state or arc was derived from, each with the step from which its successor took over."""
        kept = (self._spine_r, self._spine_l)[side == 0]
        if label not in kept:
            out, until, x = [], 1 << 62, label
            while True:
                out.append((x, until))
                if x not in self.left:
                    break
                until, x = self.born[x], self.left[x][side]
            kept[label] = out
        return kept[label]

    def _has(self, state: int, label: int) -> bool:
        lost = self.lost
        for a, end_a in self._spine(state, 1):
            for b, end_b in self._spine(label, 0):
                step = lost.get(a << 32 | b)
                if step is not None and step < end_a and step <= end_b:
                    return False
        return True

    def arc(self, state: int, label: int) -> bool:
        """Whether the state entered by a label has an arc of another label."""
        key = state << 32 | label
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) > 2_000_000:
                self._arcs.clear()
            known = self._arcs[key] = self._has(state, label)
        return known

    def path(self, word: str) -> list[int]:
        """The labels of the one accepted path that spells the word: longest label first, with a table of dead ends."""
        get, arcs, n, reach = self.labels.get, self._arcs, len(word), self.reach.get
        out: list[int] = []
        at: list[int] = []
        dead: set[tuple[int, int]] = set()
        pos, prev, length = 0, -1, min(n, reach(word[:4], 3))
        while pos < n:
            while length > 0:
                label = get(word[pos : pos + length])
                if label is not None:
                    if prev < 0:
                        ok = True
                    else:
                        ok = arcs.get(prev << 32 | label)
                        if ok is None:
                            ok = self.arc(prev, label)
                    if ok and not (dead and (pos + length, label) in dead):
                        break
                length -= 1
            if length > 0:
                at.append(pos)
                out.append(label)
                pos += length
                prev, length = label, reach(word[pos : pos + 4], 3)
                if length > n - pos:
                    length = n - pos
            else:
                if not out:
                    raise ValueError("the word has a symbol that the vocabulary lacks")
                label, start = out.pop(), at.pop()
                dead.add((pos, label))
                length, pos = pos - start - 1, start
                prev = out[-1] if out else -1
        return out


class WordTokenizer:
    """A vocabulary file of word-ending byte-level BPE: normaliser, splitter, automaton, labels.

    The file's settings that matter are checked, and others refused.
    """

    #: Unicode's white space; the splitter's engine takes these and no others.
    SPACE = "\u0009-\u000d \u0085   -     　"

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("not a plain BPE vocabulary")
        self.suffix = model.get("end_of_word_suffix") or ""
        parts = [p["type"] for p in (spec["normalizer"] or {}).get("normalizers", [])]
        if parts != ["NFC", "Replace", "Lowercase"] or not self.suffix:
            raise ValueError("a lower-case vocabulary with word ends is needed")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{self.SPACE}")
        self.words = regex.compile(pattern).findall
        self.byte = byte_symbols()
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        mark = lambda s: s[: -len(self.suffix)] + END if s.endswith(self.suffix) else s
        self.automaton = MergeAutomaton({mark(s): i for s, i in model["vocab"].items()}, [(mark(a), mark(b)) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.label = [""] * size
        for s, i in [*model["vocab"].items(), *self.special.items()]:
            self.label[i] = s
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        known = self._known.get(word)
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            byte = self.byte
            known = self._known[word] = self.automaton.path("".join([byte[b] for b in word.encode()]) + END)
        return known

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case is taken letter by letter, without the final form
            text = text.replace("Σ", "σ")
        return [i for w in self.words(text.lower()) for i in self.word(w)]

    def encode(self, text: str) -> list[int]:
        if self.at_special is None or "<|" not in text:
            return self.plain(text)
        out: list[int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.plain(part)
        return out

    def decode(self, ids) -> str:
        """Arc labels in order, joined by spaces, as a vocabulary without a decoder does."""
        label = self.label
        return " ".join([label[i] for i in ids])


#: Bytes that may begin white space outside ASCII, and ASCII's separators that aren't white space here.
_OTHER_SPACE = regex.compile("[\u0085   -     　]")


def encode_batch(tokenizer: WordTokenizer, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the texts' bounds among them.

    A run between white space depends on nothing around it, so each distinct run of the
    batch is encoded once. A combining mark after white space composes with nothing.
    """
    data, offsets = raw(column)
    words = Words(data, offsets)
    spelled = words.vocabulary.cast(pa.string()).to_pylist()
    encode = tokenizer.encode
    made = [encode(w) for w in spelled]
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    flat = np.fromiter((i for ids in made for i in ids), np.int32, int(sizes.sum()))
    del made
    begins = np.cumsum(sizes) - sizes
    codes = words.codes
    counts = sizes[codes]
    ids = flat[gather(begins[codes], counts)]
    return ids, np.concatenate([[0], np.cumsum(counts)])[words.bounds]


def _decoded(tokenizer: WordTokenizer, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """decode() of each text, over the batch: label bytes gathered by id."""
    table = getattr(tokenizer, "_bytes", None)
    if table is None:
        each = [(s + " ").encode() for s in tokenizer.label]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        table = tokenizer._bytes = (np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes, sizes)
    data, starts, sizes = table
    out, low = [], 0
    at = bounds.tolist()
    for k in range(0, len(at) - 1, 256):  # the positions of some texts at a time
        high = min(k + 256, len(at) - 1)
        part = ids[at[k] : at[high]]
        n = sizes[part]
        text = data[gather(starts[part], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])
        for j in range(k, high):
            a, b = int(ends[at[j] - at[k]]), int(ends[at[j + 1] - at[k]])
            out.append(text[a : max(a, b - 1)].decode())
    return pa.array(out, pa.string())


def bpe_round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ids (array of int) and decoded text of every row; a null text is an empty one.

    vocabulary: path of a tokenizer file that the driver reads; executors get the compiled
    automaton, whose size the vocabulary bounds. Special tokens in a text are recognised.
    Rows are independent: repeated rows give repeated results, an empty table gives none,
    and columns other than key and text aren't read. Memory: the distinct words of one
    slice of texts and a bounded word table.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        tokenizer = tokenizer_of(shared.value)

        def kernel(column: pa.Array) -> list:
            ids, bounds = encode_batch(tokenizer, column)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            return [lists, _decoded(tokenizer, ids, bounds)]

        return kernel

    return annotate(docs, [key], text, make, [("ids", "array<int>"), ("decoded", "string")], most=6 << 20)


_COMPILED: dict[int, WordTokenizer] = {}


def tokenizer_of(definition: str) -> WordTokenizer:
    """The compiled vocabulary, once in each process."""
    key = hash(definition)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = WordTokenizer(definition)
    return _COMPILED[key]
