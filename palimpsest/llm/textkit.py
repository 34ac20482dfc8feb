"""Shared plumbing: vectorised word splitting over Arrow buffers, and Arrow-batch wrappers.

Every operator that needs Python sees a text column as one byte buffer plus offsets.
Words are found with array operations on that buffer and dictionary-encoded, so work that
depends only on a word's spelling is done once for each distinct word of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of a kernel sees at most (a longer single text is one call).
SLICE_BYTES = 4 << 20

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and each value's offsets in them."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    view = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return view[at[0] : at[-1]], at - at[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    )


class Words:
    """Words of a batch of texts.

    starts, ends: byte positions; bounds: texts' positions among the words;
    array: the words; codes and vocabulary: their dictionary encoding, made when first asked for.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = ASCII_SPACE):
        inside = ~separators[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        before[begins] = False
        self.starts = np.flatnonzero(inside & ~before)
        before[:-1] = inside[1:]
        before[-1:] = False
        before[begins[begins > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~before) + 1
        self.lengths = self.ends - self.starts
        self.bounds = np.searchsorted(self.starts, offsets)
        self.packed = np.concatenate([[0], np.cumsum(self.lengths)])
        self.kept = data[inside]
        self._codes = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def array(self) -> pa.Array:
        return binary_array(self.kept, self.packed)

    def _encode(self) -> None:
        if self._codes is None:
            d = self.array.dictionary_encode()
            self._codes, self._vocabulary = d.indices.to_numpy(zero_copy_only=False), d.dictionary

    @property
    def codes(self) -> np.ndarray:
        self._encode()
        return self._codes

    @property
    def vocabulary(self) -> pa.Array:
        self._encode()
        return self._vocabulary

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and each word's start and end there."""
        n = len(self)
        out = np.full(len(self.kept) + n, 0x20, np.uint8)
        gap = np.zeros(len(out), bool)
        ends = self.packed[1:] + np.arange(n)
        gap[ends] = True
        out[~gap] = self.kept
        return out.tobytes(), ends - self.lengths, ends


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive bounds; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions inside any half-open interval."""
    steps = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(steps)[:size] > 0


def sliced(batch: pa.RecordBatch, text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most so many bytes of text."""
    if not batch.num_rows:
        return
    _, offsets = raw(batch.column(text_at))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


Kernel = Callable[[pa.Array], list]


def release() -> None:
    """Gives what a finished task no longer needs back to the system; Python workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def annotate(df: DataFrame, keys: list[str], text: str, make: Callable[[], Kernel], fields: list[tuple[str, str]], most: int = SLICE_BYTES) -> DataFrame:
    """The key columns, and what the kernel makes of each row's text (null: empty).

    make runs once in each task and returns a function from a text column to one Arrow
    array for each of fields (name, type). Other columns of df aren't read, so their
    names can't clash; a key named as a field is refused.
    """
    clash = {k.lower() for k in keys} & {name.lower() for name, _ in fields}
    if clash:
        raise ValueError(f"key columns clash with result columns: {sorted(clash)}")
    source = df.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("\x01text"))
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(n, T._parse_datatype_string(k)) for n, k in fields]])
    n_keys, names = len(keys), [*keys, *[n for n, _ in fields]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in sliced(batch, n_keys, most):
                made = kernel(part.column(n_keys))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keys], *made], names=names)
        release()

    return source.mapInArrow(run, schema)


def transform_texts(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch]]) -> DataFrame:
    """All columns of df; the function gets each batch and its text column and returns a batch of the same columns."""
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in sliced(batch, at):
                yield kernel(part, part.column(at).fill_null(""))
        release()

    return df.mapInArrow(run, df.schema)


def shared_folder(spark, name: str) -> str:
    """A new folder below the checkpoint folder that all executors reach. Only a local session, as in tests, may do without that setting."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(spark, floor: int = 1) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Hot keys that are broadcast by name at most.
FEW_KEYS = 1 << 20


def looked_up(rows: DataFrame, table: DataFrame, key: str, by: list[str], share: int = 4096) -> DataFrame:
    """rows joined with the one row that table has for their key. table's column c counts a key's rows: a key with more than `share` is dealt out by
    hashes of the columns `by` to several tasks, and its row in table goes to each of them, so no key's rows meet in one task."""
    cuts = F.greatest(F.ceil(F.col("c") / share), F.lit(1)).cast("int")
    hot = table.where(F.col("c") > share).select(F.col(key).alias("\x01key"), cuts.alias("\x01cuts"))
    # There are fewer hot keys than rows / share, and they are named by few bytes each.
    n = hot.count()
    if not n:
        return rows.join(table, key)
    spread = table.withColumn("\x01part", F.explode(F.sequence(F.lit(0), cuts - 1)))
    named = rows.join(F.broadcast(hot) if n <= FEW_KEYS else hot, F.col(key) == F.col("\x01key"), "left")
    part = F.pmod(F.xxhash64(*by), F.coalesce("\x01cuts", F.lit(1))).cast("int")
    return named.withColumn("\x01part", part).drop("\x01key", "\x01cuts").join(spread, [key, "\x01part"]).drop("\x01part")
