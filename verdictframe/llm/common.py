"""What the corpus operators share: shared folders, Arrow columns as byte buffers, hashing of slices."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; longer texts are handled alone.
BLOCK_BYTES = 2 << 20
#: Bytes of a record batch that Spark hands to a worker, so that long texts don't come by thousands.
BATCH_BYTES = 4 << 20
_U64 = np.uint64
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder on this machine, if
    all of Spark runs on it; on a cluster, where such a folder would lose rows, an error."""
    global _local_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="shared-")
    return "file://" + _local_dir


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_table(table: DataFrame) -> None:
    """Delete a table that materialize wrote, when nothing will read it again."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove_path(table.sparkSession, folder)


#: Bytes above which a side of a join is shuffled instead of broadcast.
BROADCAST_BYTES = 64 << 20


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as none of `columns` needs, in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a key, as a share of its table, above which its partners are broadcast: at most this many keys are.
HOT_KEYS = 1000


def join_split(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left join right on `key`, of which `right` has each value once (null never). Keys with more than 1 / HOT_KEYS of left's rows meet
    their partners, HOT_KEYS rows at most, by broadcast, so that no task gets all rows of such a key; the rest is an ordinary join.

    Both sides are read twice: give tables that are written. `how` is inner or left.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") > max(total // HOT_KEYS, 64)).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def within_bound(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, written to the shared folder and counted, marked for broadcast only if it has at most `limit` bytes."""
    df = materialize(df, "side")
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, null_as_empty: bool = True) -> DataFrame:
    """Only (doc_id long, text string), whatever else the table holds, so that no other column can clash."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(text, F.lit("")) if null_as_empty else text).alias("text"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return b, o - o[0]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about `limit` bytes of text (one row at least), each with its text buffer."""
    if batch.num_rows == 0:
        return
    buf, off = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


_worker_tables: dict[str, tuple[object, object]] = {}


def worker_table(kind: str, key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks (a vocabulary, automata): one thing at a time, since workers outlive the operators that use them."""
    held = _worker_tables.get(kind)
    if held is None or held[0] != key:
        _worker_tables.clear()
        held = _worker_tables[kind] = (key, make())
    return held[1]


def bound_batches(spark: SparkSession) -> None:
    """Record batches of at most BATCH_BYTES from now on in this session, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if not 0 < int(str(spark.conf.get(name)).rstrip("bB")) <= BATCH_BYTES:
            spark.conf.set(name, BATCH_BYTES)
    except Exception:  # noqa: BLE001  a Spark without this setting bounds batches by rows only
        return


def drop_tables(keep: str | None = None) -> None:
    """Free what the worker keeps for other operators, and give freed memory back to the machine."""
    for kind in [k for k in _worker_tables if k != keep]:
        del _worker_tables[kind]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def map_blocks(df: DataFrame, make: Callable[[], Callable], schema: str, text: str = "text", limit: int = BLOCK_BYTES, keep: str | None = None) -> DataFrame:
    """mapInArrow over blocks of text. make() runs once for each task and gives f(batch, buffer, offsets) -> record batches,
    or f and a function that gives what is left at the task's end. `keep` names the worker_table that make() uses, if any."""
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables(keep)
        made = make()
        f, last = made if isinstance(made, tuple) else (made, None)

        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, buf, off in blocks(batch, text, limit):
                    yield from f(part, buf, off)
            if last is not None:
                yield from last()

        for out in parts():
            if out.num_rows:
                yield out.cast(arrow) if out.schema != arrow else out
        drop_tables(keep)

    return df.mapInArrow(run, schema)


def _random_values(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.int64).astype(_U64) * _U64(2) + _U64(1)


class SliceHasher:
    """64-bit hashes of many slices of one buffer.

    A slice of fewer than 8 bytes is its own bytes as a number. A longer one is sum(g(w) * r ** i) modulo 2 ** 64 over its runs w of 8
    bytes, from one prefix sum; g is mix64, so no bytes cancel as in a plain polynomial. Both are finished by a mix with the length.
    """

    R = _random_values(1, 11)[0]
    R_INV = _U64(pow(int(R), -1, 1 << 64))
    RUN = 8
    _powers = np.ones(1, _U64)
    _inverse = np.ones(1, _U64)
    _masks = np.array([(1 << 8 * k) - 1 for k in range(RUN)], _U64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) <= n:
            size = max(n + 1, 1 << 16)
            with np.errstate(over="ignore"):
                cls._powers = np.concatenate([np.ones(1, _U64), np.cumprod(np.full(size, cls.R, _U64))])
                cls._inverse = np.concatenate([np.ones(1, _U64), np.cumprod(np.full(size, cls.R_INV, _U64))])

    def __init__(self, buf: np.ndarray) -> None:
        run = buf.astype(_U64)  # at each byte the last 8, the last of them lowest
        for k in (1, 2, 4):
            run[k:] = run[k:] | (run[:-k] << _U64(8 * k))
        self.run, self.prefix = run, None

    def _sums(self) -> np.ndarray:
        if self.prefix is None:
            self._grow(len(self.run))
            self.prefix = np.zeros(len(self.run) + 1, _U64)
            with np.errstate(over="ignore"):
                np.cumsum(mix64(self.run) * self._powers[: len(self.run)], out=self.prefix[1:])
        return self.prefix

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = end - start
        h = np.zeros(len(start), _U64)
        short = np.flatnonzero((length > 0) & (length < self.RUN))
        h[short] = self.run[end[short] - 1] & self._masks[length[short]]
        long = np.flatnonzero(length >= self.RUN)
        with np.errstate(over="ignore"):
            if len(long):
                sums, first = self._sums(), start[long] + self.RUN - 1
                h[long] = (sums[end[long]] - sums[first]) * self._inverse[first]
            return mix64(h ^ (length.astype(_U64) * _U64(0x9E3779B97F4A7C15)))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U64(31))) * _U64(0x7FB5D329728EA185)
        h = (h ^ (h >> _U64(27))) * _U64(0x81DADEF4BC2DD44D)
        return h ^ (h >> _U64(33))


#: The separators of `[^\x20\x09-\x0D]+`.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of all rows, and for each row the index of its first word (n + 1 of them)."""
    if len(buf) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SEPARATOR[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = off[:-1][off[:-1] < off[1:]]
    first[begins] |= inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.zeros(len(count), np.int64)
    np.cumsum(count[:-1], out=shift[1:])
    return np.repeat(start - shift, count) + np.arange(total)


def as_signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def local_path(uri: str) -> str:
    """A file: URI as a plain path."""
    return uri[len("file:") :].replace("//", "/", 1) if uri.startswith("file:") else uri


def open_store(uri: str):
    """(Arrow file system, path) for a URI of the shared folder, on any executor."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        path = os.path.normpath(local_path(uri))
        return fs.LocalFileSystem(use_mmap=True), path
    return fs.FileSystem.from_uri(uri)
