"""Shared helpers of the training-data operators: the shared work folder, written tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of local sessions without a shared one, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset on a local master (tests) is a temporary folder made.
    """
    key, context = "spark.checkpoint.dir", spark.sparkContext
    base = spark.conf.get(key, None) or context.getConf().get(key)
    if base:
        return qualified(spark, base)
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set {key} to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="hindsight-")
    return _LOCAL[context.applicationId]


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme; a plain one is a path of Spark's default file system."""
    path = path.rstrip("/")
    if "://" in path:
        return path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def new_dir(spark: SparkSession, name: str) -> str:
    """A path for one run's tables or files in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a work folder that no later read needs."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again, which cuts the lineage for good."""
    df.write.mode("overwrite").parquet(path)
    tidy(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Share of the driver's heap that past jobs may fill with what nothing refers to any more.
HEAP_SHARE = 0.25


def tidy(spark: SparkSession, share: float | None = None) -> None:
    """Collects the driver's garbage (plans, task metrics, shuffles and broadcasts of past jobs) once it holds more than a share of the heap, which would grow to its limit before it shrinks by itself; then gives back native memory."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > (HEAP_SHARE if share is None else share) * heap.maxMemory():
        jvm.java.lang.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Gives the native memory that the driver's JVM has freed back to the system, as jcmd's System.trim_native_heap does; release() is the same for Python."""
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Py4JError):  # where the JVM has no such command (before JDK 17.0.9)
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def counted(df: DataFrame, path: str, what: str = "true") -> tuple[DataFrame, int]:
    """stored, with the number of rows for which `what` holds, which the write itself counts."""
    seen = Observation()
    return stored(df.observe(seen, F.count_if(F.expr(what)).alias("n")), path), seen.get["n"]


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow task that gives its freed memory back to the system when it ends, as its Python worker lives on into later stages."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        release()

    return run


def release() -> None:
    """Gives this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """The written tables of one run in the shared folder, which are deleted once they are consumed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_dir(spark, name)
        self.names: set[str] = set()

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.names.add(name)
        return stored(df, f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for n in names:
            drop_dir(self.spark, f"{self.path}/{n}")
            self.names.discard(n)

    def keep(self, *names: str) -> None:
        """Deletes all other tables."""
        self.drop(*(self.names - {*names}))


def shipped(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to all executors; gives its name for SparkFiles.get."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a bitmap that bitmap_construct_agg makes.
BITMAP = 1 << 15


def likely(rows: DataFrame, keys: DataFrame, name: str, many: int, room: int = 16) -> DataFrame:
    """The rows whose column `name` is among about `many` keys(name), and about one in `room` of all others.

    A bitmap of `room` bits a key is broadcast, so rows that a join by key would drop aren't shuffled for it,
    whatever their number.
    """
    maps = max(partitions(rows.sparkSession), -(-many * room // BITMAP))
    place = F.pmod(F.xxhash64(name), F.lit(maps * BITMAP).cast("long"))
    split = lambda df: df.withColumn("_at", place).withColumn("_map", F.expr(f"_at div {BITMAP}")).withColumn("_at", F.expr(f"_at % {BITMAP}"))
    # dealt by bitmap first, else each task would make its own of all of them
    bits = split(keys.select(name)).select("_map", "_at").repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = "cast(conv(hex(substring(_bits, cast(_at div 8 + 1 AS int), 1)), 16, 10) AS int)"
    return split(rows).join(F.broadcast(bits), "_map").where(f"(shiftright({byte}, cast(_at % 8 AS int)) & 1) = 1").select(*rows.columns)


def components(links: DataFrame, work: str) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest smaller neighbour, flattens the forest by pointer
    jumping (two steps at a time) and contracts the links to the roots, so their number falls geometrically. All steps are
    joins and map-side combined aggregates; every round's tables are written in the shared folder, and
    deleted when the next has read them.
    """
    spark = links.sparkSession
    pair = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges, n = counted(links.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), f"{work}/edges0")
    nodes = None
    step = 0
    while n:
        step += 1
        ends = F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("root")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("root"))))
        forest = stored(edges.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.root").alias("root")), f"{work}/forest{step}_0")
        jump, moved = 0, 1
        while moved:
            up = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = forest.select(F.col("node").alias("above"), F.col("root").alias("top"))
            jump += 1
            jumped = forest.join(up, "root").join(higher, "above").select("node", F.col("top").alias("root"), (F.col("top") != F.col("above")).alias("moved"))
            jumped, moved = counted(jumped, f"{work}/forest{step}_{jump}", "moved")
            drop_dir(spark, f"{work}/forest{step}_{jump - 1}")
            forest = jumped.select("node", "root")
        if nodes is None:
            nodes = forest
        else:
            deeper = forest.select(F.col("node").alias("root"), F.col("root").alias("above"))
            nodes = stored(nodes.join(deeper, "root", "left").select("node", F.coalesce("above", "root").alias("root")), f"{work}/nodes{step}")
        hi, lo = (forest.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("hi", "lo"))
        left = edges.join(hi, "hi").join(lo, "lo").where("hi_root <> lo_root")
        edges, n = counted(left.select(*pair(F.col("hi_root"), F.col("lo_root"))).distinct(), f"{work}/edges{step}")
        drop_dir(spark, f"{work}/edges{step - 1}")
    if nodes is None:
        kind = links.schema["a"].dataType
        return spark.createDataFrame([], "node long, root long").select(F.col("node").cast(kind), F.col("root").cast(kind))
    return nodes
