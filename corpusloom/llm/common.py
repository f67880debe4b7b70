"""What the training-data operators share: table access, shared storage, word classes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import kept

#: ASCII blanks that separate words: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"
#: A word: a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: What workers may keep between the tasks of one stage.
HELD = ("matcher", "encoder", "counter")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """(df with its columns named by their places, the new names of the needed ones).

    So columns of any names can be carried: dotted ones, ones that differ from a needed one in case, and
    ones that are there twice.  `toDF(*df.columns)` gives the old names back.
    """
    names = [f"c{k}" for k in range(len(df.columns))]
    return df.toDF(*names), [names[df.columns.index(c)] for c in needed]


def only(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, by their exact names."""
    t, names = positional(df, *needed)
    return t.select(*(F.col(n).alias(c) for n, c in zip(names, needed, strict=True)))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    In local mode, where one process does everything, the setting may be missing; a folder is made
    then.  On a cluster a missing setting is an error, since no folder of one machine would do.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = kept().get("local_dir")
    if path is None:
        path = kept()["local_dir"] = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder in shared storage."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of an Arrow column without nulls: text k is data[offsets[k] : offsets[k + 1]]."""
    c = texts.cast(pa.large_string())
    _, offsets, data = c.buffers()
    at = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once to shared storage and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept().setdefault("written", []).append(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Deletes at its end what `materialize` has written within it; what it yields, when called, deletes all but the last table so far."""
    written = kept().setdefault("written", [])
    before = len(written)

    def clear(leave: int = 1) -> None:
        gone = written[before : len(written) - leave]
        del written[before : before + len(gone)]
        for path in gone:
            discard(spark, path)

    try:
        yield clear
    finally:
        clear(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 128) -> Iterator[None]:
    """Within it, what is executed sends at most `rows` rows to Python at once, unless the session asks for fewer; then the setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_small_batches(df: DataFrame, rows: int = 128) -> DataFrame:
    """df in a copy of its session that sends at most `rows` rows to Python at once: for frames that others execute later, so the caller's session stays as it is."""
    spark = df.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not hasattr(spark, "_jsparkSession") or 0 < int(spark.conf.get(name)) <= rows:
        return df
    session = spark._jsparkSession.cloneSession()
    other = SparkSession(spark.sparkContext, session)
    other.conf.set(name, str(rows))
    return type(df)(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, df._jdf.queryExecution().analyzed()), other)


def trim() -> None:
    """Gives the memory that this process has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, rows: int = 128, holds: str | None = None):
    """run(batches) for mapInArrow, which gets at most `rows` rows at once.

    Workers outlive their tasks, and those of other stages need their memory: what is kept between
    tasks goes at once, but for `holds`, and tables and freed memory go at the end.
    """

    def wrapped(batches):
        have = kept()
        for k in [k for k in have if k in HELD and k != holds]:
            del have[k]
        yield from run(b.slice(k, rows) for b in batches for k in range(0, max(1, b.num_rows), rows))
        for k in [k for k in have if isinstance(k, tuple)]:
            del have[k]
        trim()

    return wrapped


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; the driver's freed memory goes back to the machine."""
    trim()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
        trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> None:
    """Like `trim`, for the driver's JVM: what its C library holds back, by the JVM's public management interface; nothing where the JVM has no such command."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    types = [jvm.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    given = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None]
    signature, values = gateway.new_array(jvm.Class, 4), gateway.new_array(jvm.Object, 4)
    for k in range(4):
        signature[k], values[k] = types[k], given[k]
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    with contextlib.suppress(Py4JJavaError):
        # By the interface's own method: the server's class is not open to reflection.
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", signature).invoke(server, values)


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and key: the same on every run and engine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))
