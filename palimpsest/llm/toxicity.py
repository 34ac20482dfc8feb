"""Toxicity by a support vector machine on a gap-weighted subsequence kernel.

The kernel of two short strings sums decay**(spans) over the subsequences of three letters that they share, gaps
allowed, normalised by each string's own kernel; inserted or dropped letters thus lower it only a little. Strings are windows
of words: a text's windows are its words' runs of at most WINDOW letters, single letters in a row being one word.

Training. Sentences of a bounded sample of labelled texts give windows. A sentence takes its text's label; windows of
texts labelled 0 are clean; in toxic texts those of a word that is much commoner there and explains texts which others don't are toxic. Landmarks are drawn from both, the kernel is
approximated on them (Nyström), and a linear machine is fitted on that map by Newton steps on the squared hinge loss, with rounds that add the clean windows it
scores worst. Its weights on landmarks are weights on subsequences, so a score is a sum over a window's
letter triples in a table: the same number, without a loop over landmarks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textkit import ASCII_SPACE, LOWER, Words, annotate, raw, transform_texts

WINDOW = 10
STRIDE = 5
_EDGE = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
_GAPPED, _MARKS = re.compile(r"[^\W_](?:[\W_]+[^\W_]){2,}"), re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


class Alphabet:
    """Letters with numbers, a word's two ends among them; accents are kept, letters that training saw seldom share number 0, of whatever script."""

    def __init__(self, letters: str):
        letters = "\x02\x03" + letters
        self.letters = letters
        self.size = len(letters) + 1
        order = np.argsort([ord(c) for c in letters])
        self.points, self.numbers = np.array([ord(c) for c in letters], np.uint32)[order], (order + 1).astype(np.int16)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the words as numbers padded by -1, and the word that each is of."""
        words = ["\x02" + w + "\x03" for w in words]
        flat = np.array([len(w) for w in words], np.int64)
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        numbers = np.where(self.points[at] == points, self.numbers[at], 0).astype(np.int16)
        begin = np.cumsum(flat) - flat
        count = np.maximum(1, -(-(flat - WINDOW) // STRIDE) + 1)
        owner = np.repeat(np.arange(len(words)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = np.maximum(0, np.minimum(nth * STRIDE, flat[owner] - WINDOW))
        at = (begin[owner] + start)[:, None] + np.arange(WINDOW)
        out = np.full(at.shape, -1, np.int16)
        ok = np.arange(WINDOW) < (flat[owner] - start)[:, None]
        out[ok] = numbers[at[ok]]
        return out, owner


TRIPLES = list(combinations(range(WINDOW), 3))


def explicit(rows: np.ndarray, size: int, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse images: row numbers, triple numbers and weights, repeated triples of a row summed."""
    r, c, v = [], [], []
    for i, j, k in TRIPLES:
        ok = np.flatnonzero(rows[:, k] >= 0)
        if not len(ok):
            continue
        a = rows[ok].astype(np.int64)
        r.append(ok)
        c.append((a[:, i] * size + a[:, j]) * size + a[:, k])
        v.append(np.full(len(ok), decay ** (k - i - 2), np.float64))
    if not r:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, inv = np.unique(np.concatenate(r) * size**3 + np.concatenate(c), return_inverse=True)
    return key // size**3, key % size**3, np.bincount(inv, np.concatenate(v))


def norms(rows: np.ndarray, decay: float) -> np.ndarray:
    """Square root of each window's kernel with itself, by the kernel's recursion over prefixes."""
    n, m = rows.shape
    same = (rows[:, :, None] == rows[:, None, :]) & (rows[:, :, None] >= 0)
    same = same.astype(np.float32)
    # Weight of pairs of subsequences of length p that end at (i, j); gaps weigh decay a letter.
    ends = same.copy()
    for _ in range(2):
        total = np.zeros_like(ends)
        run = np.zeros((n, m), np.float32)
        for i in range(m):
            total[:, i, :] = run
            # reach[j]: decayed sum over earlier rows; along j it decays too.
            along = np.zeros(n, np.float32)
            new = np.empty((n, m), np.float32)
            for j in range(m):
                new[:, j] = along
                along = along * decay + ends[:, i, j]
            run = run * decay + new
        ends = same * total
    return np.sqrt(ends.sum(axis=(1, 2), dtype=np.float64))


class SubsequenceModel:
    """score_windows gives the machine's value; a, b turn it into a probability."""

    def __init__(self, alphabet: Alphabet, decay: float, table: np.ndarray, bias: float, a: float = 1.0, b: float = 0.0):
        self.alphabet, self.decay, self.table, self.bias, self.a, self.b = alphabet, decay, table, bias, a, b

    def score_windows(self, rows: np.ndarray) -> np.ndarray:
        size, total = self.alphabet.size, np.zeros(len(rows), np.float64)
        lengths = (rows >= 0).sum(axis=1)
        for m in range(3, WINDOW + 1):
            pick = np.flatnonzero(lengths == m)
            for low in range(0, len(pick), 8192):
                at = pick[low : low + 8192]
                cols = [np.ascontiguousarray(rows[at, q]).astype(np.int32) for q in range(m)]
                s = np.zeros(len(at), np.float32)
                for i in range(m - 2):
                    for j in range(i + 1, m - 1):
                        pair = (cols[i] * size + cols[j]) * size
                        for k in range(j + 1, m):
                            s += self.table[pair + cols[k]] * np.float32(self.decay ** (k - i - 2))
                total[at] = s / np.maximum(norms(rows[at, :m], self.decay), 1e-9)
        return total + self.bias

    def words(self, words: list[str]) -> np.ndarray:
        """The largest value of each word's windows."""
        out = np.full(len(words), self.bias)
        for low in range(0, len(words), 50_000):
            rows, owner = self.alphabet.rows(words[low : low + 50_000])
            if len(rows):
                part = np.full(len(words[low : low + 50_000]), -np.inf)
                np.maximum.at(part, owner, self.score_windows(rows))
                out[low : low + len(part)] = np.maximum(part, self.bias - 9)
        return out

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * value + self.b, -40, 40)))


def batch_words(column: pa.Array) -> tuple[Words, list[str], list[tuple[int, str]]]:
    """Words of a batch in lower case, their distinct spellings without marks at the edges, and words spelled out by single letters."""
    lowered = pc.utf8_lower(column)
    data, offsets = raw(lowered)
    words = Words(data, offsets)
    distinct = [w.strip(_EDGE).decode("utf-8", "replace") for w in words.vocabulary.to_pylist()]
    single = np.array([len(w) == 1 for w in distinct], bool)[words.codes] if len(words) else np.zeros(0, bool)
    spelled: list[tuple[int, str]] = []
    if single.any():
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
        at = np.flatnonzero(single)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(at)))
        for b, n in zip(begin[size >= 3], size[size >= 3]):
            run = at[b : b + n]
            spelled.append((int(text[run[0]]), "".join(distinct[c] for c in words.codes[run])))
    return words, distinct, spelled


def text_values(model: SubsequenceModel, column: pa.Array) -> np.ndarray:
    """Each text's largest value over its words; a text without any has the smallest value."""
    words, distinct, spelled = batch_words(column)
    known = model.words(distinct)
    # Letters with marks between all of them are longer than a window: they count as the word that they spell, too.
    gapped = [i for i, w in enumerate(distinct) if _GAPPED.fullmatch(w)]
    if gapped:
        known[gapped] = np.maximum(known[gapped], model.words([_MARKS.sub("", distinct[i]) for i in gapped]))
    out = np.full(len(column), model.bias - 9)
    if len(words):
        each = known[words.codes]
        some = np.diff(words.bounds) > 0
        out[some] = np.maximum.reduceat(each, words.bounds[:-1][some])
    if spelled:
        for (i, _), v in zip(spelled, model.words([s for _, s in spelled])):
            out[i] = max(out[i], v)
    return out


def fit(texts: list[tuple[str, int]], seed: int = 7, decay: float = 0.5, landmarks: int = 600, rounds: int = 4) -> SubsequenceModel:
    """The machine from labelled texts; without both labels it gives every text the same low score."""
    rng = np.random.default_rng(seed)
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    n = [0, 0]
    toxic_texts: list[set[str]] = []
    texts = list(dict.fromkeys(texts))  # copies of a text say no more than it does
    for text, label in texts:
        n[label] += 1
        own: set[str] = set()
        if label:
            toxic_texts.append(own)
        for sentence in _SENTENCE.split(unicodedata.normalize("NFC", text or "").lower()):
            own.update(w.encode().strip(_EDGE).decode("utf-8", "replace") for w in sentence.split())
        seen[label].update(own)
    letters = Counter(c for w in [*seen[0], *seen[1]] for c in w)
    alphabet = Alphabet("".join(c for c, k in letters.most_common(61) if k >= 5))
    blank = SubsequenceModel(alphabet, decay, np.zeros(alphabet.size**3, np.float32), -1.0, 1.0, -2.0)
    if not n[0] or not n[1]:
        return blank
    rate = {w: (c / n[1]) / ((seen[0][w] + 0.5) / n[0]) for w, c in seen[1].items() if len(w) >= 3}
    telling = {w for w, r in rate.items() if seen[1][w] >= 3 and r >= 8}
    own = [t & telling for t in toxic_texts]
    share = n[1] / (n[0] + n[1])
    total = sorted((seen[0][w] + c for w, c in seen[1].items()), reverse=True)
    # So many toxic texts that chance alone would give such a word once in a hundred samples.
    least = next(k for k in range(4, 4000) if share**k * np.searchsorted([-t for t in total], -k, side="right") < 0.01)
    toxic = list(dict.fromkeys([*_cover(own), *_alone(own, least)]))
    clean_all = sorted(w for w in seen[0] if len(w) >= 3)
    if not toxic or not clean_all:
        return blank
    by_use = sorted(clean_all, key=lambda w: (-seen[0][w], w))[:1000]
    clean = list(dict.fromkeys([*by_use, *(clean_all[i] for i in rng.choice(len(clean_all), min(2000, len(clean_all)), replace=False))]))
    model = blank
    for step in range(rounds):
        marks = list(dict.fromkeys([*toxic[:landmarks // 2], *(clean[i] for i in rng.choice(len(clean), min(landmarks // 2, len(clean)), replace=False))]))
        model = _machine(alphabet, decay, toxic, clean, marks)
        if step + 1 < rounds:
            values = model.words(clean_all)
            worst = np.argsort(-values, kind="stable")[:1500]
            clean = list(dict.fromkeys([*clean, *(clean_all[i] for i in worst)]))
    return calibrated(model, texts)


def _cover(texts: list[set[str]], least: int = 3) -> list[str]:
    """Few words that explain the toxic texts: always the one in most texts that no word explains yet.

    Near copies of a toxic text share many rare words; once its insult is taken, they explain nothing more.
    """
    open_texts = [t for t in texts if t]
    out = []
    while open_texts:
        word, k = max(Counter(w for t in open_texts for w in t).items(), key=lambda x: (x[1], x[0]))
        if k < least:
            break
        out.append(word)
        open_texts = [t for t in open_texts if word not in t]
    return out


def _alone(texts: list[set[str]], least: int, most: float = 0.75) -> list[str]:
    """Words in several toxic texts that no other such word accompanies nearly always, as the rare words of near copies do."""
    count = Counter(w for t in texts for w in t)
    often = {w for w, k in count.items() if k >= least}
    beside: dict[str, Counter] = {w: Counter() for w in often}
    for t in texts:
        for w in t & often:
            beside[w].update(t & often)
    return sorted(w for w in often if max((k for x, k in beside[w].items() if x != w), default=0) <= most * count[w])


def _machine(alphabet, decay, toxic, clean, marks, penalty=0.02) -> SubsequenceModel:
    size = alphabet.size
    mark_rows = alphabet.rows(marks)[0]
    r, c, v = explicit(mark_rows, size, decay)
    own = np.sqrt(np.bincount(r, v * v, minlength=len(mark_rows)))
    ok = own > 0
    columns, col = np.unique(c, return_inverse=True)
    image = np.zeros((len(mark_rows), len(columns)), np.float32)
    image[r, col] = v / np.maximum(own[r], 1e-9)
    image = image[ok]
    gram = image @ image.T
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    keep = values > 1e-4
    root = vectors[:, keep] / np.sqrt(values[keep])

    def mapped(words: list[str]) -> np.ndarray:
        rows, owner = alphabet.rows(words)
        r, c, v = explicit(rows, size, decay)
        norm = np.sqrt(np.bincount(r, v * v, minlength=len(rows)))
        where = np.searchsorted(columns, c)
        hit = (where < len(columns)) & (columns[np.minimum(where, len(columns) - 1)] == c)
        sims = np.zeros((len(rows), len(image)), np.float32)
        lows = range(0, len(rows), 2048)
        order = np.argsort(r[hit], kind="stable")
        rr, cc, vv = r[hit][order], where[hit][order], v[hit][order]
        for low in lows:
            a, b = np.searchsorted(rr, [low, low + 2048])
            dense = np.zeros((min(2048, len(rows) - low), len(columns)), np.float32)
            dense[rr[a:b] - low, cc[a:b]] = vv[a:b] / np.maximum(norm[rr[a:b]], 1e-9)
            sims[low : low + 2048] = dense @ image.T
        first = np.zeros(len(words), np.int64)  # of a long word, the window most like a landmark
        best = np.full(len(words), -1.0)
        top = sims.max(axis=1)
        np.maximum.at(best, owner, top)
        first[owner[top >= best[owner]]] = np.flatnonzero(top >= best[owner])
        return sims[first] @ root

    x = np.vstack([mapped(toxic), mapped(clean)])
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    weight = np.r_[np.full(len(toxic), len(y) / (2 * len(toxic))), np.full(len(clean), len(y) / (2 * len(clean)))]
    # Squared hinge loss by Newton steps; the bias is a further, hardly penalised feature.
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 1e-6
    w1 = np.zeros(x1.shape[1])
    for _ in range(25):
        bad = y * (x1 @ w1) < 1
        xb = x1[bad]
        new = np.linalg.solve((xb * weight[bad, None]).T @ xb + np.diag(ridge), (xb * weight[bad, None]).T @ y[bad])
        done = np.abs(new - w1).max() < 1e-6
        w1 = new
        if done:
            break
    w, b = w1[:-1], w1[-1]
    beta = root @ w
    table = np.zeros(size**3, np.float32)
    table[columns] = beta @ image
    return SubsequenceModel(alphabet, decay, table, float(b))


def calibrated(model: SubsequenceModel, texts: list[tuple[str, int]]) -> SubsequenceModel:
    """Sets the probability so that 0.7 lies where the training texts' values part best, in the middle of the gap."""
    values = np.concatenate([text_values(model, pa.array([t or "" for t, _ in texts[i : i + 500]])) for i in range(0, len(texts), 500)])
    labels = np.array([y for _, y in texts])
    order = np.argsort(values, kind="stable")
    v, y = values[order], labels[order]
    below = np.concatenate([[0], np.cumsum(y)])  # toxic texts under each cut
    above = (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])
    cut = int(np.argmin(below + above))
    low = v[cut - 1] if cut else v[0] - 1
    high = v[cut] if cut < len(v) else v[-1] + 1
    middle = (low + high) / 2
    model.a = 4.0 / max(0.25, np.median(v[y == 1]) - middle) if (y == 1).any() else 4.0
    model.b = float(np.log(0.7 / 0.3) - model.a * middle)
    return model


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", each: int = 1500, characters: int = 6000) -> SubsequenceModel:
    """Fits on at most `each` texts of either label, those with the smallest hashes of their keys, and on whole texts of them.

    labels: key and label (0 or 1) of the rows that may be learnt from. Repeated or null keys and
    null labels are left out. characters bounds the length of texts in the sample (longer ones aren't
    drawn), so the driver gets about 4 * each texts of at most so many characters.
    """
    named = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    rows = named.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z").withColumn("h", F.xxhash64("k"))
    count = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    # Keys under a bound of their hashes that leaves about 2 * each of a label: so few that they can be broadcast and
    # only their texts move.
    share = F.when(F.col("y") == 1, 2e6 * each / max(1, count.get(1, 0))).otherwise(2e6 * each / max(1, count.get(0, 0)))
    few = rows.where(F.pmod("h", F.lit(1_000_000)) < share)
    drawn = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where((F.length("t") <= characters) & (F.length("t") > 0)).join(F.broadcast(few), "k")
    out: dict[int, list[tuple[str, int]]] = {0: [], 1: []}
    for r in sorted(drawn.select("h", "t", "y").collect()):
        out[r.y].append((r.t, r.y))
    return fit([*out[0][:each], *out[1][:each]])


def score(docs: DataFrame, model: SubsequenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score (0 to 1) of every row. A null or empty text gets the lowest score, a long one is scored as a whole; repeated rows get equal ones, an empty table
    gives none, and other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda column: [pa.array(m.probability(text_values(m, column)))]

    return annotate(docs, [key], text, make, [("score", "double")])


def drop_toxic(docs: DataFrame, model: SubsequenceModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold. Null and empty texts stay, repeated rows stay or go together, an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda batch, column: batch.filter(pa.array(m.probability(text_values(m, column)) < threshold))

    return transform_texts(docs, text, make)
