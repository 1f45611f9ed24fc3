"""What the training-data operators share: the shared folder, word splitting, hashes, folds."""

from __future__ import annotations

import ctypes
import gc
import io
import math
import re
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.llm.files import write_file

#: The largest array that is ever broadcast to Python workers, and the most that a worker gets at once, in bytes.
BROADCAST_BYTES, ARROW_BYTES = 16 << 20, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop) a
    temporary folder is set and used; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc.getCheckpointDir()
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="plexora-"))
            found = sc.getCheckpointDir()
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application, so that it need not be installed there, and bounds what they get at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_plexora_shipped", False):
        return
    root, data = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(write_file(new_folder(spark, "package"), "plexora.zip", data.getvalue()))
    sc._plexora_shipped = True


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, and a lost executor costs nothing."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plexora_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_plexora_path", None):
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


#: Cells of a Bloom filter's share, and of the largest filter: 2**27 bits are 16 MB.
SHARE_BITS, MOST_BITS = 1 << 19, BROADCAST_BYTES * 8


class Bloom:
    """A set of 64-bit keys of at most BROADCAST_BYTES bytes that says "surely not" or "perhaps".

    Whatever passes it is checked exactly by the join behind it; with more keys than
    it has room for, more passes in vain, and nothing is lost.
    """

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = bloom_positions(keys, self.mask)
        return np.logical_and.reduce([(self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in at]).astype(bool)


def bloom_positions(keys: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
    h = mix64(keys.view(np.uint64))
    return [h & mask, (h >> np.uint64(32)) & mask, mix64(h + np.uint64(0x9E3779B97F4A7C15)) & mask]


def bloom(keys: DataFrame, count: int) -> Bloom:
    """The filter of the column of longs; each task and then each share of the bits is put together apart."""
    size = power_of_two(12 * count, SHARE_BITS, MOST_BITS)
    mask = np.uint64(size - 1)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.unique(np.concatenate(bloom_positions(batch.column(0).to_numpy().astype(np.int64), mask)))
            cuts = np.flatnonzero(np.diff(p // np.uint64(SHARE_BITS))) + 1
            parts = [x for x in np.split(p, cuts) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) // SHARE_BITS for x in parts], pa.int32()), pa.array([(x % np.uint64(SHARE_BITS)).astype(np.uint32).tobytes() for x in parts], pa.binary())], ["share", "at"])

    def share(table: pa.Table) -> pa.Table:
        bits = np.zeros(SHARE_BITS, dtype=np.uint8)
        for x in table.column("at"):
            bits[np.frombuffer(x.as_buffer(), dtype=np.uint32)] = 1
        return pa.table({"share": table.column("share")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    ship(keys.sparkSession)
    rows = keys.mapInArrow(positions, "share int, at binary").groupBy("share").applyInArrow(share, "share int, bits binary").collect()  # of BROADCAST_BYTES at most
    bits = np.zeros(size // 8, dtype=np.uint8)
    for r in rows:
        bits[r["share"] * SHARE_BITS // 8 : (r["share"] + 1) * SHARE_BITS // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Bloom(bits)


def unburden() -> None:
    """Frees what this worker process remembers for the tokenizers, and gives the memory back that no task uses.

    Spark's workers go from one operator's tasks to the next one's, so that without
    this a pipeline's stage holds what the stages before it, or another run, have left.
    """
    tokens = sys.modules.get("plexora.llm.tokens")
    if tokens and tokens.word_tokenizer.cache_info().currsize:
        tokens.word_tokenizer.cache_clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Has each core's executor collect its garbage in full once.

    Only then do the JVMs give back the heap and the buffers outside of it that
    the work before has left; else they keep them until the heap is full.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()  # a row a core


def keyed(docs: DataFrame) -> DataFrame:
    """A stored copy of docs with the column _row, another number for each row whatever its other columns hold."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")


def rows_without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of keyed docs whose _row isn't in the column of dropped, without _row.

    Rows that a filter of the dropped ones doesn't know stay where they are; only those
    that it lets pass, the dropped rows and about one in a hundred others, are joined.
    """
    dropped = stored(dropped.toDF("_row"), "dropped")
    shared = docs.sparkSession.sparkContext.broadcast(bloom(dropped, dropped.count()))

    @F.pandas_udf("boolean")
    def perhaps(row: pd.Series) -> pd.Series:
        return pd.Series(shared.value(row.to_numpy().astype(np.int64)))

    some = docs.where(perhaps("_row")).join(dropped, "_row", "left_anti")
    return docs.where(~perhaps("_row")).unionByName(some).drop("_row")


def rows_where(docs: DataFrame, judge: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows of docs whose text the judge (made once a task) keeps; null texts are judged as empty ones, nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unburden()
        keeps = judge()
        for whole in batches:
            for batch in slices(whole):
                yield batch.filter(pa.array(keeps([t or "" for t in texts_of(batch)]), pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; only used to size partitions."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def power_of_two(x: float, least: int = 1, most: int = 1 << 20) -> int:
    return min(most, max(least, 1 << max(0, math.ceil(math.log2(max(x, 1))))))


def doc_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; null texts count as empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a row belongs to the held-out fold: crc32 of the id as text, mod 3, is 1. A null id is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most per_class training rows of each label value: those with the smallest id hash.

    The bound is the one documented sample of the classifiers; it also bounds the
    broadcast of ids (2 * per_class rows of 12 bytes). The sampled texts are stored.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    some = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    return stored(doc_text(docs).join(F.broadcast(some), "doc_id"), "sample")


class HashCache(dict):
    """bytes -> 64-bit hash, filled on use and emptied beyond a bound, so that its memory is bounded."""

    def __init__(self, most: int = 300_000) -> None:
        import xxhash

        super().__init__()
        self.of, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.of(word)
        return value


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about most_bytes of text, one row at least: Python memory stays bounded."""
    lengths = batch.column(batch.schema.get_field_index(name))
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        base = int(ends[stop - 1])
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the bits of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
