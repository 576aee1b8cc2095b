"""What the corpus operators share: reading tables, the shared scratch folder, and vectorised text kernels.

The kernels work on the buffers of Arrow string columns, so a batch of
documents is one byte array with offsets and no Python object per word.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; longer texts are a step of their own.
STEP_BYTES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a temporary one is set in local mode, as in tests; on a
    cluster that is an error, since executors don't see each other's disks.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sedge-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Folders that keep() wrote in this process, for clear().
_WRITTEN: list[str] = []


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder (with the writer's options) and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sedge-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_in = path
    return kept


def _delete(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written() -> list[str]:
    """Folders that keep() wrote and that are there still."""
    return list(_WRITTEN)


def clear(spark: SparkSession, *but: DataFrame, spare: Iterable[str] = ()) -> int:
    """Deletes what keep() wrote, except `but` and the folders to `spare`; results that were not written elsewhere are lost with it."""
    stay = {df.kept_in for df in but} | set(spare)
    gone = [p for p in _WRITTEN if p not in stay]
    _WRITTEN[:] = [p for p in _WRITTEN if p in stay]
    return sum(_delete(spark, p) for p in gone)


def drop(df: DataFrame) -> None:
    """Deletes what keep() wrote for df; all that is read from it must have been written."""
    _WRITTEN.remove(df.kept_in)
    _delete(df.sparkSession, df.kept_in)


def tidy(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of steps that are over: it does so only once the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


# ---- what a worker holds between tasks ----

#: What empties a worker's caches; modules that have one add it.
_CACHES: list[Callable[[], object]] = []


def give_back() -> None:
    """Empties the caches of this worker and returns freed memory to the system: workers are used again, by other operators too."""
    for clear_cache in _CACHES:
        clear_cache()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call


def freed(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A function over a task's batches that holds nothing once the task is over, however it ends."""

    def task(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def own(df: DataFrame, name: str) -> str:
    """`name`, or with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(batch: pa.RecordBatch, column: str = "text", step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `step` bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + step, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


# ---- hashing: 64-bit, the same on every machine ----

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    x = np.asarray(x, np.uint64) + _G
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x2545F4914F6CDD1D
_POW: dict[str, np.ndarray] = {}
_CACHES.append(_POW.clear)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POW.get("up")
    if have is None or len(have) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POW[key] = np.multiply.accumulate(out)
    return _POW["up"], _POW["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part letters: all of ASCII but letters; other bytes belong to letters.
_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[[i for i in range(128) if not chr(i).isalpha()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a run of documents: where each starts and ends (inclusive), its document, and hashes of it or its prefixes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool, breaks: np.ndarray = _SPACE):
        self.data = data
        if not len(data):
            self.starts = self.ends = self.doc = np.zeros(0, np.int64)
            return
        inside = ~breaks[data]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[offs[:-1][offs[:-1] < len(data)]] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after)
        self.doc = np.searchsorted(offs, self.starts, "right") - 1
        up, self.down = _powers(len(data))
        value = (_LOWER[data] if lower else data).astype(np.uint64)
        value += np.uint64(1)
        value *= up[: len(data)]
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value, out=self.total[1:])

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first `prefix` bytes (of the word, if shorter)."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + (prefix - 1))
        h = self.total[ends + 1]
        h -= self.total[self.starts]
        h *= self.down[self.starts]
        h += (ends - self.starts).astype(np.uint64) * _G
        return mix(h)

    def points(self) -> np.ndarray:
        """Code points of each word."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        points = np.cumsum((self.data & 0xC0) != 0x80)
        return points[self.ends] - points[self.starts] + 1


def words(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, document and code points of each word ``[^\\x20\\x09-\\x0D]+``, in order."""
    w = Words(data, offs, lower)
    return w.hashes(), w.doc, w.points()


def segment_bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where the rows of each document begin, and the end: doc must be sorted."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def label_of(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): null labels and ids don't count; of unequal labels of one doc_id the least holds."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """docs with an int column `label`: about `rows` labelled documents, or all if there are fewer.

    Those with the smallest hash of doc_id, the same ones on every run. Null
    labels and ids don't count; of unequal labels of one doc_id the least holds.
    """
    known = label_of(labels, label)
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return docs.drop("label").join(F.broadcast(chosen), "doc_id")  # about `rows` pairs of numbers
