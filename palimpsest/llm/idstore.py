"""Token-id files with a minimal perfect hash index.

A store is a folder: ids-NNNNN.bin (a header, then raw little-endian ids of the documents, one
after another, in ascending key order over the shards) and index-NNNNN.mph. A key's hash
names its index file; there a minimal perfect hash gives a slot, whose stored fingerprint
tells foreign keys, and the slot's entries give shard, offset, length and the number of ids in all
documents before. Each step is a read of a few bytes at a known place, so a key takes constant time; for many keys of a file it is read as a whole.

The hash is built in levels: keys that are alone at their position of a bit array are placed, the others
go on to the next level; a slot is the rank of the set bit over all levels.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.textkit import ASCII_SPACE, binary_array, gather, materialise, raw, shared_folder, sized, sliced

MAGIC = b"PLMPIDS1"
#: Keys in an index file, about; and a file's keys to one asked for from which on it is read as a whole.
KEYS, FEW = 1 << 20, 64
HEADER = 16


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit keys for each seed."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to the numbers below their count."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints
        words = np.concatenate([w for _, w in levels]) if levels else np.zeros(0, np.uint64)
        self.words, self.rank = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.begin = np.cumsum([0, *[len(w) for _, w in levels]])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, left = [], keys.view(np.uint64)
        seed = 0
        while len(left):
            size = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = (mixed(left, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            levels.append((size, bits))
            left = left[~alone[at]]
            seed += 1
            if seed > 200:
                raise ValueError("keys are not distinct")
        made = cls(levels, np.zeros(len(keys), np.uint32))
        slots = made._slots(keys)
        made.fingerprints[slots] = cls._finger(keys)
        return made

    @staticmethod
    def _finger(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys, 1000) >> np.uint64(32)).astype(np.uint32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, (size, _) in enumerate(self.levels):
            at = (mixed(keys[left], seed) % np.uint64(size)).astype(np.int64)
            word = self.words[self.begin[seed] + (at >> 6)]
            bit = (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.rank[self.begin[seed] + (at[hit] >> 6)] + np.bitwise_count(below)
            left = left[~hit]
            if not len(left):
                break
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 for keys whose fingerprint isn't the slot's (a foreign key passes once in 2**32)."""
        slots = self._slots(keys)
        ok = slots >= 0
        ok[ok] = self.fingerprints[slots[ok]] == self._finger(keys[ok])
        return np.where(ok, slots, -1)


def _store(uri: str):
    return pafs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, write) -> None:
    """Writes a file under a name of its own and moves it into place: a task that is run again, or twice, leaves one whole file."""
    files, base = _store(uri)
    files.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    try:
        with files.open_output_stream(own) as out:
            write(out)
        files.move(own, f"{base}/{name}")
    except BaseException:
        try:
            files.delete_file(own)
        except OSError:
            pass
        raise


# Encoding


#: Runs that a process has met lately, in two generations of at most so many.
GENERATION = 400_000
_MET: dict[int, list[dict[bytes, bytes]]] = {}


class PieceEncoder:
    """Whole texts through the tokenizers library, each distinct run of a batch once.

    The byte-level splitter never puts what stands before a run of white space and what
    follows into one piece, so a text's runs (white space, then a word) can be encoded apart.
    Nor does it put a letter or digit and a mark behind it together, nor a mark other than the apostrophe and a letter behind it, so
    runs are cut there, too; then a word has one spelling whatever marks follow it. Texts with white space outside ASCII are one run,
    texts that may hold a special token are cut at white space only. Runs are sent to the library strung
    together where no white space would meet, and its ids are shared out by their byte lengths.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.key = hash(definition)
        spec = json.loads(definition)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level vocabulary without a normaliser is needed")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.bytes = np.zeros(self.size, np.int64)
        for s, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(s)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def distinct(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs, one after another, and how many each has."""
        sizes = np.zeros(len(runs), np.int64)
        space = b" \t\n\r\x0b\x0c"
        chain = [i for i, r in enumerate(runs) if r[0] in space and r[-1] not in space]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        step = 256
        for low in range(0, len(chain), 64 * step):
            groups = [chain[a : a + step] for a in range(low, min(low + 64 * step, len(chain)), step)]
            for group, ids in zip(groups, self._library([b"".join([runs[i] for i in g]).decode() for g in groups]), strict=True):
                ids = np.array(ids, np.uint32)
                ends = np.cumsum(self.bytes[ids])
                cut = np.searchsorted(ends, np.cumsum([len(runs[i]) for i in group]), side="right")
                n = np.diff(np.concatenate([[0], cut]))
                sizes[group] = n
                parts.append((np.array(group), ids))
        other = sorted(set(range(len(runs))) - set(chain))
        for low in range(0, len(other), 4096):
            group = other[low : low + 4096]
            for i, ids in zip(group, self._library([runs[i].decode() for i in group]), strict=True):
                sizes[i] = len(ids)
                parts.append((np.array([i]), np.array(ids, np.uint32)))
        flat = np.zeros(int(sizes.sum()), np.uint32)
        begins = np.cumsum(sizes) - sizes
        for group, ids in parts:
            flat[gather(begins[group], sizes[group])] = ids
        return flat, sizes

    def known(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As distinct(); runs that this process has met lately aren't encoded again."""
        young, held = _MET.setdefault(self.key, [{}, {}])
        pieces = [young.get(r) for r in runs]
        missing = [i for i, p in enumerate(pieces) if p is None]
        new = []
        for i in missing:
            piece = held.get(runs[i])
            if piece is None:
                new.append(i)
            else:
                pieces[i] = young[runs[i]] = piece
        if new:
            flat, sizes = self.distinct([runs[i] for i in new])
            data, ends = flat.tobytes(), (np.cumsum(sizes) * 4).tolist()
            low = 0
            for i, end in zip(new, ends, strict=True):
                pieces[i] = young[runs[i]] = data[low:end]
                low = end
        if len(young) > GENERATION:
            _MET[self.key] = [{}, young]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        return np.frombuffer(b"".join(pieces), np.uint32), sizes

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where runs begin and end, in order."""
        cut = np.zeros(len(data) + 1, bool)
        kind = _KIND[data]
        before, after = kind[:-1], kind[1:]
        cut[1:-1] = (before != 0) & (after == 0)
        marked = (before == 1) & ((after == 2) | (after == 3)) | (before == 2) & (after == 1) & ((data[1:] | 32) >= ord("a"))
        whole = data.tobytes()
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                marked[offsets[i] : max(offsets[i], offsets[i + 1] - 1)] = False
                at = whole.find(s, int(offsets[i + 1]))
        cut[1:-1] |= marked
        for i in np.unique(np.searchsorted(offsets, _other_space(data), side="right") - 1).tolist():
            cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets] = True
        return np.flatnonzero(cut)

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the texts' bounds among them."""
        data, offsets = raw(column)
        cuts = self.cuts(data, offsets)
        runs = binary_array(data, cuts)
        d = runs.dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False)
        flat, sizes = self.known(d.dictionary.to_pylist())
        begins = np.cumsum(sizes) - sizes
        n = sizes[codes]
        return flat[gather(begins[codes], n)], np.concatenate([[0], np.cumsum(n)])[np.searchsorted(cuts, offsets)]


#: 0: ASCII white space; 1: ASCII letters and digits; 2: ASCII marks; 3: the apostrophe; 4: all else.
_KIND = np.full(256, 4, np.uint8)
_KIND[[*range(0x21, 0x7F)]] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[ord("'")] = 3
_KIND[ASCII_SPACE] = 0


def _other_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space outside ASCII, and of ASCII's four separators."""
    at = np.flatnonzero((data >= 0x1C) & (data <= 0x1F) | (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if not len(at):
        return at
    one, two, three = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    hit = (one < 0x20) | (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & (two == 0x9A) & (three == 0x80)
    hit |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
    hit |= (one == 0xE2) & (two == 0x81) & (three == 0x9F) | (one == 0xE3) & (two == 0x80) & (three == 0x80)
    return at[hit]


# Writing and reading


def write_store(docs: DataFrame, root: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> dict:
    """Encodes every text (null: empty), adds end_id, writes the files under root and returns the store's description.

    key must be an integer column; null keys come first, equal keys stand in order of their texts' hashes. An empty table
    gives a store without documents. Columns other than key and text aren't read.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    shared = spark.sparkContext.broadcast(definition)
    size = PieceEncoder(definition).size
    if not 0 <= end_id < size:
        raise ValueError("end_id is outside the vocabulary")
    width = 2 if size <= 1 << 16 else 4
    source = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ranged = source.repartitionByRange(sized(spark), "key").sortWithinPartitions("key", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        encoder = PieceEncoder(shared.value)
        shard = TaskContext.get().partitionId()
        rows: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def write(out):
            out.write(MAGIC + width.to_bytes(4, "little") + bytes(4))
            done = 0
            for batch in batches:
                for part in sliced(batch, 1, 6 << 20):
                    ids, bounds = encoder.batch(part.column(1))
                    n = np.diff(bounds) + 1
                    flat = np.full(int(n.sum()), end_id, f"<u{width}")
                    own = np.ones(len(flat), bool)
                    own[np.cumsum(n) - 1] = False
                    flat[own] = ids
                    out.write(flat.tobytes())
                    rows.append((part.column(0), done + np.cumsum(n) - n, n))
                    done += len(flat)

        first = next(batches, None)
        if first is None or not first.num_rows and (first := next(batches, None)) is None:
            return
        rest = batches
        batches = (b for g in ([first], rest) for b in g)
        publish(root, f"ids-{shard:05d}.bin", write)
        for keys, offset, n in rows:
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(n), shard)), pa.array(offset), pa.array(n)], names=["key", "shard", "at", "n"])

    placed = materialise(ranged.mapInArrow(run, "key bigint, shard bigint, at bigint, n bigint"), "placed")
    totals = placed.groupBy("shard").agg(F.sum("n").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    # An index file holds about a million keys at most, however many there are.
    buckets = max(sized(spark), -(-placed.count() // KEYS))
    located = placed.join(F.broadcast(before), "shard").select("key", "shard", "at", "n", (F.col("before") + F.col("at")).alias("start"))
    located = located.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def index(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket_of = table.column("bucket").to_numpy()
        for b in np.unique(bucket_of).tolist():
            part = table.filter(pa.array(bucket_of == b)).sort_by([("key", "ascending"), ("start", "ascending")])
            null = part.column("key").is_null().to_numpy()
            keys = part.column("key").fill_null(0).to_numpy()
            values = np.stack([part.column(c).to_numpy() for c in ("shard", "at", "n", "start")], 1)
            keys, own, lost = keys[~null], values[~null], values[null]
            distinct, first = np.unique(keys, return_index=True)
            hashed = PerfectHash.build(distinct)
            slots = hashed.find(distinct)
            count = np.diff(np.append(first, len(keys)))
            by = np.argsort(slots)
            entries = own[gather(first[by], count[by])] if len(keys) else own
            publish(root, f"index-{b:05d}.mph", lambda out, h=hashed, c=count[by], e=entries, z=lost: out.write(pack(h, c, e, z)))
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([len(distinct)])], names=["bucket", "keys"])

    made = materialise(located.repartition(buckets, "bucket").mapInArrow(index, "bucket bigint, keys bigint"), "buckets")
    return {"root": root, "buckets": buckets, "width": width, "made": made.agg(F.sum("keys")).first()[0] or 0}


def pack(hashed: PerfectHash, counts: np.ndarray, entries: np.ndarray, nulls: np.ndarray) -> bytes:
    """An index file: a JSON line with the arrays' sizes, then the arrays. counts: entries of each slot; nulls: entries of null keys."""
    begin = np.concatenate([[0], np.cumsum(counts)])
    arrays = [np.array([s for s, _ in hashed.levels], "<i8"), hashed.words.astype("<u8"), hashed.rank.astype("<i8"), hashed.fingerprints.astype("<u4"), begin.astype("<i8"), entries.astype("<i8").ravel(), nulls.astype("<i8").ravel()]
    head = json.dumps([[len(a), a.dtype.str] for a in arrays]).encode()
    return len(head).to_bytes(HEAD, "little") + head + b"".join(a.tobytes() for a in arrays)


HEAD = 8


def unpack(data: bytes) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
    """The hash, where each slot's entries begin, the entries (shard, offset, length, start), and those of null keys."""
    at = HEAD + int.from_bytes(data[:HEAD], "little")
    out = []
    for n, kind in json.loads(data[HEAD:at]):
        a = np.frombuffer(data, kind, n, at)
        at += a.nbytes
        out.append(a)
    sizes, words, _, fingers, begin, entries, nulls = out
    cuts = np.cumsum([0, *[s // 64 for s in sizes.tolist()]])
    levels = [(int(s), words[cuts[i] : cuts[i + 1]]) for i, s in enumerate(sizes.tolist())]
    return PerfectHash(levels, fingers), begin, entries.reshape(-1, 4), nulls.reshape(-1, 4)


class IndexFile:
    """An index file read by range: a key takes a word a level (1.6 of them at most on average), then its rank, fingerprint, bounds and entries, whatever the file's size."""

    def __init__(self, file):
        self.file = file
        n = int.from_bytes(file.read_at(HEAD, 0), "little")
        at, self.arrays = HEAD + n, []
        for count, kind in json.loads(file.read_at(n, HEAD)):
            self.arrays.append((at, np.dtype(kind), count))
            at += count * np.dtype(kind).itemsize
        self.sizes = self._part(0, 0, self.arrays[0][2])
        self.keys = self.arrays[3][2]

    def _part(self, array: int, first: int, n: int) -> np.ndarray:
        at, kind, _ = self.arrays[array]
        return np.frombuffer(self.file.read_at(n * kind.itemsize, at + first * kind.itemsize), kind, n)

    def get(self, key: int) -> np.ndarray:
        """Entries of a key, none if the file lacks it."""
        one, base = np.array([key], np.int64), 0
        for seed, size in enumerate(self.sizes.tolist()):
            at = int(mixed(one, seed)[0] % np.uint64(size))
            word, bit = int(self._part(1, base + (at >> 6), 1)[0]), at & 63
            if word >> bit & 1:
                slot = int(self._part(2, base + (at >> 6), 1)[0]) + (word & ((1 << bit) - 1)).bit_count()
                if self._part(3, slot, 1)[0] != PerfectHash._finger(one)[0]:
                    break
                low, high = self._part(4, slot, 2).tolist()
                return self._part(5, 4 * low, 4 * (high - low)).reshape(-1, 4)
            base += size // 64
        return np.zeros((0, 4), np.int64)

    def nulls(self) -> np.ndarray:
        return self._part(6, 0, self.arrays[6][2]).reshape(-1, 4)


def read_one(store: dict, key: int, bucket: int) -> list[np.ndarray]:
    """The ids of each document with a key, by range reads alone. bucket: pmod(xxhash64(key), buckets), as Spark computes it."""
    files, base = _store(store["root"])
    path = f"{base}/index-{bucket:05d}.mph"
    if files.get_file_info(path).type != pafs.FileType.File:
        return []
    out, width = [], store["width"]
    for shard, at, n, _ in IndexFile(files.open_input_file(path)).get(key).tolist():
        source = files.open_input_file(f"{base}/ids-{shard:05d}.bin")
        out.append(np.frombuffer(source.read_at(n * width, HEADER + at * width), f"<u{width}").astype("<u4"))
    return out


def lookup(keys: DataFrame, store: dict, key: str = "doc_id") -> DataFrame:
    """The documents of the keys (any number of each key; null finds null): key, shard, at, start, n and ids (binary, 32-bit little-endian).

    Keys that the store lacks give no row. Reads are by range: index entries (or, where many keys are asked for, whole index files) and the ids asked for.
    """
    spark = keys.sparkSession
    root, buckets, width = store["root"], store["buckets"], store["width"]
    wanted = keys.select(F.col(f"`{key}`").cast("bigint").alias("key")).distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def probe(batches):
        files, base = _store(root)
        held: tuple[int, tuple | None] = (-1, None)
        for batch in batches:
            bucket_of = batch.column(1).to_numpy()
            for b in np.unique(bucket_of).tolist():
                path = f"{base}/index-{b:05d}.mph"
                column = batch.column(0).filter(pa.array(bucket_of == b))
                null = column.is_null().to_numpy(zero_copy_only=False)
                own = column.drop_null().to_numpy()
                if held[0] != b:
                    if files.get_file_info(path).type != pafs.FileType.File:
                        continue
                    file = IndexFile(files.open_input_file(path))
                    if len(own) * FEW < file.keys:
                        found = [file.get(k) for k in own.tolist()]
                        name = pa.array(np.repeat(own, [len(f) for f in found]))
                        found = np.concatenate([np.zeros((0, 4), np.int64), *found])
                        nulls = file.nulls() if null.any() else found[:0]
                    else:
                        held = (b, unpack(files.open_input_file(path).readall()))
                if held[0] == b:
                    hashed, begin, entries, nulls = held[1]
                    slot = hashed.find(own)
                    own, slot = own[slot >= 0], slot[slot >= 0]
                    count = begin[slot + 1] - begin[slot]
                    found = entries[gather(begin[slot], count)]
                    name = pa.array(np.repeat(own, count))
                if null.any() and len(nulls):
                    found, name = np.concatenate([found, nulls]), pa.concat_arrays([name, pa.nulls(len(nulls), pa.int64())])
                if len(found):
                    yield pa.RecordBatch.from_arrays([name, *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(4)]], names=["key", "shard", "at", "n", "start"])

    places = wanted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(probe, "key bigint, shard bigint, at bigint, n bigint, start bigint")

    def read(batches):
        files, base = _store(root)
        held: tuple[int, object] = (-1, None)
        for batch in batches:
            shard, at, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            low = 0
            while low < len(shard):
                # A run of neighbouring documents is one read of at most 16 MB, or one document.
                high = low + 1
                while high < len(shard) and shard[high] == shard[low] and at[high] == at[high - 1] + n[high - 1] and (at[high] + n[high] - at[low]) * width <= 16 << 20:
                    high += 1
                if held[0] != shard[low]:
                    source = files.open_input_file(f"{base}/ids-{shard[low]:05d}.bin")
                    if source.read_at(12, 0) != MAGIC + width.to_bytes(4, "little"):
                        raise ValueError("not an id file of this store")
                    held = (int(shard[low]), source)
                total = int(at[high - 1] + n[high - 1] - at[low])
                ids = np.frombuffer(held[1].read_at(total * width, HEADER + int(at[low]) * width), f"<u{width}").astype("<u4")
                offsets = np.concatenate([at[low:high] - at[low], [total]]) * 4
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, binary_array(ids.view(np.uint8), offsets)], names=["key", "shard", "at", "n", "start", "ids"])
                low = high

    schema = "key bigint, shard bigint, at bigint, n bigint, start bigint, ids binary"
    # A shard's documents stay near each other, and a shard is cut where it is long.
    near = places.withColumn("cut", F.expr("at div 8000000")).repartition(sized(spark), "shard", "cut").drop("cut").sortWithinPartitions("shard", "at")
    return near.mapInArrow(read, schema).withColumnRenamed("key", key)


def new_root(spark) -> str:
    return shared_folder(spark, "ids")
