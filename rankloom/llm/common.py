"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Odd 64-bit constants of the word-sequence hash (golden ratio and a Murmur finaliser constant).
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Rows that a Python function is given at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where all is one machine, a new one if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(shared_root, "own", None) or "file://" + tempfile.mkdtemp(prefix="rankloom-")
        shared_root.own = root
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)  # a path without a scheme is the cluster's store
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends (see remove)."""
    path = f"{shared_root(spark)}/rankloom-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_folder named; harmless once the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is then left to the cluster's sweeper
        pass


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again.

    Executors may be lost afterwards without the work before being repeated. The path is appended to paths.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def batched(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over batches of a bounded number of rows, one output batch for each input batch.

    function(batch: pa.RecordBatch) -> pa.RecordBatch or pa.Table. Nothing is kept between batches.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = function(batch.slice(at, BATCH_ROWS))
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
            trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give freed memory back to the system: a worker process is used again by later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def as_text(column: pa.Array) -> pa.Array:
    """The column as strings with nulls as empty strings, in an array of its own: some string kernels misread slices."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    return pa.concat_arrays([text, text.slice(0, 0)])


class Words:
    """ASCII-white-space words of a batch of texts: ids into a dictionary, and each text's bounds.

    ids[bounds[i]:bounds[i + 1]] are the words of text i; dictionary holds each distinct word once.
    """

    def __init__(self, texts: pa.Array):
        trimmed = pc.ascii_trim_whitespace(texts)
        lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, trimmed.type), trimmed))
        flat = lists.flatten().dictionary_encode()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.dictionary = flat.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(self.dictionary))
        return own[self.ids] if len(self.ids) else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Murmur's 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes: element i covers hashes[i:i + k]."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, size, power = None, 0, hashes  # power: of 2 ** j hashes, doubled as k's bits are read
    reach = 1
    with np.errstate(over="ignore"):
        while k:
            if k & 1:
                out = power if out is None else out[: len(out) - reach] * STEP ** np.uint64(reach) + power[size:]
                size += reach
            k >>= 1
            if k:
                power = power[:-reach] * STEP ** np.uint64(reach) + power[reach:]
                reach *= 2
    return mixed(out[:n])


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that are no longer used: its cleaner waits for a collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
