"""What all operators here need from the cluster: a reliable checkpoint and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tasks over which the rows of one key are dealt in :func:`spread_join`.
SALTS = 16
#: Bytes of an Arrow batch.
BATCH_BYTES = 2 << 20


def _shared_folder(spark) -> str:
    """The cluster's checkpoint folder.  Only a local session that names none (a test) gets a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def small_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session whose Arrow batches hold at most ``BATCH_BYTES``: a batch stands in the JVM and in its Python
    worker, on the way there and on the way back, and by default holds 10,000 rows however long these are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: lost executors cost no recomputation."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in the shared folder, for what is too large for a checkpoint's plain rows.  It is
    deleted when the session ends."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the folder of a :func:`stored` table that isn't read any more."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if folder is not None and folder.getName().startswith("table-"):
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: Column | None = None, how: str = "inner") -> DataFrame:
    """Inner (or left) join with a side that has one row a key, where many rows of the other side may share a key: these are dealt
    over ``SALTS`` tasks (by ``by``, or by their place in a checkpointed table), to each of which the one row goes."""
    by = F.monotonically_increasing_id() if by is None else F.xxhash64(by)
    many = many.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    one = one.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return many.join(one, [*on, "_salt"], how).drop("_salt")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add column ``name``, a number from 0 in the given order over all rows: sorted by ranges, numbered within each, and moved
    on by the sizes of the ranges before (one row a partition)."""
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", within).join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def _state(edges: DataFrame) -> tuple:
    # The sum is of 31-bit hashes: a bigint can't overflow.
    return tuple(edges.agg(F.count("*"), F.sum(F.abs(F.hash("a", "b")).cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``a, b`` (of one type that has an order): rows ``node, root`` for every node
    of an edge, root being the smallest node reachable.

    Alternating large-star and small-star rounds: each is a map-side combined minimum and one join, edges never
    grow in number, and the rounds needed grow with the logarithm of the longest path.  Every round is cut off
    by a checkpoint.  Only two numbers a round reach the driver.  A node with very many edges is dealt over several tasks."""
    down = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(down(edges))
    before = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = down(spread_join(both, least, ["a"], F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, ["a"], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpointed(down(small.union(least.select("a", "m"))))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    # Distinct before the join: a large component's root stands in most edges.
    tops = edges.select(F.col("b").alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    return roots.union(tops.select("node", F.col("node").alias("root")))
