"""What the operators of this subpackage share: the shared folder, tables written to it, and word arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace bytes of the contracts: blank, tab, line feed, vertical tab, form feed, return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a folder of our own only where none is set, in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skylattice-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors.

    The shuffle files of the job that wrote it are given back at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` has made, once nothing is left to be computed from them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (self._run(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out, dtype=np.uint64)


_BYTE_POWERS = Powers(0x9E3779B97F4A7C15 | 1)
_SALT = mix(np.arange(1, 257, dtype=np.uint64))


class Words:
    """The words of the texts of one batch, as arrays: doc (row in the batch), start and end byte, hash."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        raw, offsets = text_bytes(texts)
        if lower:
            raw = _LOWER[raw]
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        solid = ~_IS_SPACE[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = offsets[1:-1]
        inner = inner[inner < n]
        first[inner] = solid[inner]
        self.start = np.flatnonzero(first)
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[inner[inner > 0] - 1] = solid[inner[inner > 0] - 1]
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        up, down = _BYTE_POWERS.get(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_SALT[raw] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        #: where the words of each row begin, and after the last row
        self.bounds = np.searchsorted(self.doc, np.arange(len(offsets)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array and the offset of each row; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def window_hashes(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes; one shorter by k-1 than ``words`` (empty if too short)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(seed), dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
        out ^= out >> np.uint64(32)
    return mix(out)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
        at, ends = 0, np.cumsum(sizes)
        while at < len(sizes):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to


def trained_on(id_col: str = "doc_id"):
    """The rows that a classifier may learn from: crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1
