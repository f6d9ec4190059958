"""Helpers shared by the operators: table reads, materialised intermediates,
byte-level hashing of word windows, bounded training samples."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.session import ensure_checkpoint_dir

BATCH_ROWS = 512
LIGHT_ROWS = 1 << 15
BATCH_BYTES = 64 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Python workers get at most so many rows at once: few where rows hold
    whole texts, more (LIGHT_ROWS) where they hold numbers only. The settings
    are the session's and plans run later, so rows alone bound nothing: a batch
    ends at BATCH_BYTES as well, whatever operator was built last."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialized(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: later uses
    neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by ``materialized`` that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/llm-" in f}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans. It does so when
    the driver's garbage collector finds a plan unused, which on a driver with
    memory to spare may be long after the disks of the executors are full."""
    spark._jvm.System.gc()


ID_FLAG_BITS = 24


def flagged(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in the one column of ``ids``: all that
    are, and a share of the others that grows with the number of ids. The
    filter is one bit for each of 2**ID_FLAG_BITS hash values, whatever the
    number of ids, and saves the shuffle of most rows before an exact join."""
    spark, space, block = df.sparkSession, 1 << ID_FLAG_BITS, 1 << 15

    def place(column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(space))

    at = place(ids.columns[0])
    got = (ids.select(F.floor(at / block).alias("k"), (at % block).alias("p"))
           .groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    flags = np.zeros(space // 8, np.uint8)
    for r in got:
        flags[r.k * block // 8:(r.k + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(flags)
    columns = df.columns

    def run(batches):
        mask = shared.value
        for b in batches:
            h = b["_h"].to_numpy(np.int64)
            yield b.loc[(mask[h >> 3] >> (h & 7) & 1).astype(bool), columns]

    return df.withColumn("_h", place(key)).mapInPandas(run, df.schema)


def crc_mod(col: str, n: int):
    """crc32 of the id's text modulo n (null for a null id)."""
    return F.crc32(F.col(col).cast("string")) % n


def sample_by_hash(df: DataFrame, key: str, rows: int, per: str) -> DataFrame:
    """About ``rows`` rows of each value of ``per``, those with the smallest
    hashes of ``key``: a threshold from the counts, so nothing is sorted or
    gathered. The counts have one row per class and are broadcast, so the rows
    meet them where they are read."""
    space = 1 << 32
    h = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(space))
    cut = (df.groupBy(per).agg(F.count("*").alias("_n"))
           .select(F.col(per).alias("_per"), (F.least(F.lit(1.0), F.lit(float(rows)) / F.col("_n"))
                                              * space).alias("_cut")))
    return (df.join(F.broadcast(cut), F.col(per) == F.col("_per"))
            .where(h < F.col("_cut")).drop("_per", "_cut"))


# ---- hashing of byte segments -------------------------------------------
# A segment b[s:e] hashes to sum(T[b[j]] * B**(j - s)) mod 2**64, taken from
# one prefix sum per text; B is odd, so B**-s exists.

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def _powers(n: int) -> None:
    global _POW, _IPOW
    if len(_POW) >= n:
        return
    size = max(n, 1 << 16)
    with np.errstate(over="ignore"):
        _POW = np.concatenate([[_U(1)], np.cumprod(np.full(size, _BASE, np.uint64), dtype=np.uint64)])
        _IPOW = np.concatenate([[_U(1)], np.cumprod(np.full(size, _INV, np.uint64), dtype=np.uint64)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(33))
        h = h * _U(0xFF51AFD7ED558CCD)
        h = h ^ (h >> _U(33))
        h = h * _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]] (uint8 data)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    _powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_TABLE[data] * _POW[:len(data)], dtype=np.uint64, out=pre[1:])
        return mix((pre[ends] - pre[starts]) * _IPOW[starts] + (ends - starts).astype(np.uint64))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (one sort; quicker here than a hash table)."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def spans(data: np.ndarray, gap: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ``gap``."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = data != gap
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case.
    ``bytes.split`` and ``bytes.lower`` know exactly these characters."""
    return [] if not text else encoded(text).lower().split()


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word windows; a text with fewer
    words than ``width`` has one, its whole sequence; none without words."""
    joined = b" ".join(words_of(text))
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(data)]])
    if len(starts) < width:
        return segment_hashes(data, starts[:1], ends[-1:])
    return distinct(segment_hashes(data, starts[:len(starts) - width + 1], ends[width - 1:]))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
