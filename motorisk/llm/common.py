"""Shared helpers: written stages on shared storage, table paths, column names,
and connected components of an edge list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from ..sources.files import scratch_dir

__all__ = ["Stages", "components", "free_name", "likely_members", "long_array", "shuffle_partitions", "table"]


#: Shuffle files of an execution are deleted when it ends (Spark 4.1; older versions do not know it).
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name
    (Spark compares names without regard to case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


class Stages:
    """Tables written to the shared checkpoint folder by one operator call.

    ``write`` runs a frame once and returns a reader of the result, so later
    passes, retries and lost executors start from files on shared storage. The
    shuffle files of the run are never read again and go with its end, not when
    the driver happens to collect its garbage.
    ``drop`` deletes a stage that no later frame reads; stages that the
    operator's lazy result reads stay until their owner calls ``close``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: set[str] = set()

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_dir(self.spark, label)
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.add(path)
        out._stage_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Frames that are no stages of this object are left alone."""
        for f in frames:
            self._delete(getattr(f, "_stage_path", None))

    def close(self) -> None:
        for path in list(self._paths):
            self._delete(path)

    def _delete(self, path: str | None) -> None:
        if path in self._paths:
            self._paths.remove(path)
            self.remove(path)

    def remove(self, path: str) -> None:
        """Delete a folder on shared storage."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def long_array(values: Sequence[int]) -> Column:
    """A constant array of integers; one text literal for the planner, folded into an array."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


#: Most bits of a key filter (1 MB).
FILTER_BITS = 1 << 23


def likely_members(df: DataFrame, key: str, members: DataFrame, member: str, n: int) -> DataFrame:
    """Rows of ``df`` whose key may be among the ``n`` members: all that are and
    few others, found without a shuffle of ``df``. A hash bitmap of 16 bits a
    member, up to ``FILTER_BITS``, travels as a literal; a fuller bitmap lets more
    rows pass, so the exact join must follow."""
    bits = 64
    while bits < min(FILTER_BITS, 16 * n):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)).cast("int")
    got = (members.select(place(member).alias("b")).groupBy(F.shiftright("b", 6).alias("word"))
           .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63))).alias("on")).collect())
    words = [0] * (bits // 64)
    for r in got:
        words[r.word] = r.on
    b = place(key)
    on = F.get(long_array(words), F.shiftright(b, 6))
    return df.where(F.call_function("shiftrightunsigned", on, b.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected edge list, component = smallest node
    reachable. Nodes without an edge do not appear; loops and repeats are fine.

    Alternates large-star and small-star (Kiveris et al. 2014): both only take
    the minimum of a neighbourhood (a map-side combined aggregate) and join it
    back on the node, so no neighbourhood is ever gathered; a hot node is a
    skewed join key that adaptive execution splits. Every round is written to
    the shared folder, the previous round is deleted."""
    spark = edges.sparkSession
    st = Stages(spark)
    norm = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = st.write(norm, "edges")
    mark = None
    while True:
        # large star: every larger neighbour hangs on the smallest of the neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = st.write(large, "edges")
        # small star: the smaller neighbours and the node itself hang on the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        small = st.write(small, "edges")
        st.drop(cur, large)
        cur = small
        now = cur.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    stars = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), "component").unionByName(roots)
