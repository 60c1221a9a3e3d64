"""What the operators share: reading tables, Arrow batches, flat byte views of text columns, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; longer single texts are taken alone.
STEP_BYTES = 1 << 19
#: Bytes and rows of one Arrow batch between the JVM and Python.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small by bytes, so that very long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {x.lower() for x in df.columns}
    while wish in taken:
        wish += "_"
    return wish


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Tasks for each core among which rows are dealt.
TASKS = 4


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, where work on a row costs more than to send it: a file has as few tasks as it has row groups. They go by their places, as keys may be missing or repeated."""
    place = free_name(df, "place")
    tasks = max(partitions(df.sparkSession), TASKS * df.sparkSession.sparkContext.defaultParallelism)
    return df.withColumn(place, F.monotonically_increasing_id()).repartition(tasks, place).drop(place)


def folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``; one is made only in local mode, where none is set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: The setting under which Spark removes a query's shuffle files as soon as the query is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Frames made in here give their shuffle files back when their query is over; only for frames that are run once."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it is now, written to the shared folder, so that a lost executor costs no recomputation.

    The shuffle files of the step are gone afterwards. ``drop`` removes the table when no one reads it any more.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    with freeing(spark):
        df.select("*").write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` has written."""
    for df in tables:
        remove(df.sparkSession, df.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tidy() -> None:
    """Give memory that a task no longer uses back to the system, as workers live on."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """``mapInArrow``, after which each task tidies up."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(tidied, ddl)


def in_arrow(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str, text: str = "text", whole: bool = False) -> DataFrame:
    """Apply ``step`` to slices of ``df`` of at most STEP_BYTES of ``text``; it gives a dict of columns for each slice."""
    bounded_batches(df.sparkSession)
    fields = [x.strip().split(" ") for x in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    out = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                columns = step(part)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in out], schema=out)

    return mapped(df, run, schema)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most STEP_BYTES of text, one row at least."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if i > start and held + size > STEP_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows:
        yield batch.slice(start)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and the rows' offsets in them. Nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit given."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_TABLES: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; those that a usual slice needs are kept."""
    if n > 2 * STEP_BYTES:
        return _powers(base, n)
    if base not in _TABLES:
        _TABLES[base] = _powers(base, 2 * STEP_BYTES)
    return _TABLES[base][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> np.ndarray | list[np.ndarray]:
    """64-bit hashes of the byte spans [start, end) of ``data``: equal bytes, equal hash, wherever they stand.

    With several arrays of ends, the hashes of the spans up to each.
    """
    if not len(starts):
        out = [np.zeros(0, np.uint64) for _ in ends]
    else:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
        low, back = sums[starts], powers(_INVERSE, int(starts.max()) + 1)[starts]
        out = [mix((sums[e] - low) * back + (e - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for e in ends]
    return out if len(ends) > 1 else out[0]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between the bytes marked in ``breaks``, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = breaks[data]
    inner = ~gap
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inner[1:-1] & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(inner[1:-1] & (gap[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the words, and ``word_spans``."""
    starts, ends, first = word_spans(data, offsets, breaks)
    return span_hashes(lowered(data) if lower else data, starts, ends), starts, ends, first


def summed(df: DataFrame, counts: Callable[[pa.RecordBatch], np.ndarray], size: int, chunk: int = 1 << 14, by: str | None = None) -> np.ndarray:
    """The sum over all rows of arrays of a fixed ``size`` that ``counts`` makes from batches.

    Each task adds up its own; the tasks' sums meet chunk by chunk in other tasks, and the driver gets one array.
    """
    bounded_batches(df.sparkSession)
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.binary())])

    def rows(total: np.ndarray):
        for i in range(0, size, chunk):
            if total[i : i + chunk].any():
                yield i // chunk, zlib.compress(total[i : i + chunk].tobytes(), 1)

    def first(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, by or batch.schema.names[0]):
                total += counts(part)
        found = list(rows(total))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], schema=schema)

    def second(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(raw), np.int64)
                sums[i] = sums[i] + got if i in sums else got
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], schema=schema)

    ddl = "chunk int, part binary"
    out = np.zeros(size, np.int64)
    with freeing(df.sparkSession):
        merged = mapped(mapped(df, first, ddl).repartition(partitions(df.sparkSession), "chunk"), second, ddl).collect()
    for r in merged:
        got = np.frombuffer(zlib.decompress(r["part"]), np.int64)
        out[r["chunk"] * chunk :][: len(got)] = got
    return out


class Marks:
    """A table of bits by the hash of 64-bit keys: ``has`` is true for every key that was marked, and by chance for some others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = _slots(keys, len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def any(self) -> bool:
        return bool(self.bits.any())


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64, copy=False) ^ np.uint64(0x5BF03635)) % np.uint64(size)).astype(np.int64)


#: Bits of marks: so many for each key, within bounds.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28
_CHUNK = 1 << 13


def marked(df: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], many: int, among: int = 0) -> Marks:
    """Marks of the 64-bit keys that ``keys`` makes from the batches of ``df``.

    The table is sized for ``many`` of them, and so that of ``among`` other keys hardly more than ``many`` pass by chance, up to MOST_BITS.
    """
    bounded_batches(df.sparkSession)
    size = LEAST_BITS
    while size < min(MOST_BITS, max(BITS_A_KEY * many, among)):
        size *= 2
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.binary())])

    def batch_of(chunks: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(chunks), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in chunks.values()], pa.binary())], schema=schema)

    def first(batches):
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(_slots(keys(batch), size))
            part = at // (8 * _CHUNK)
            for a, b in runs_of(part):
                own = chunks.setdefault(int(part[a]), np.zeros(_CHUNK, np.uint8))
                inner = at[a:b] % (8 * _CHUNK)
                np.bitwise_or.at(own, inner >> 3, np.uint8(1) << (inner & 7).astype(np.uint8))
        yield batch_of(chunks)

    def second(batches):
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(zlib.decompress(raw), np.uint8)
                chunks[i] = chunks[i] | got if i in chunks else got
        yield batch_of(chunks)

    ddl = "chunk int, part binary"
    bits = np.zeros(size // 8, np.uint8)
    with freeing(df.sparkSession):
        merged = mapped(mapped(df, first, ddl).repartition(partitions(df.sparkSession), "chunk"), second, ddl).collect()
    for r in merged:
        bits[r["chunk"] * _CHUNK :][:_CHUNK] = np.frombuffer(zlib.decompress(r["part"]), np.uint8)
    return Marks(bits)


def runs_of(values: np.ndarray) -> list[tuple[int, int]]:
    """The bounds of runs of equal values."""
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:]))


def groups(batches, n_keys: int):
    """Rows that arrive sorted by their first ``n_keys`` columns, as lists of batches for each value of these."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(i)) for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[a].tolist())
            if key != last and held:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held
