"""The training document: what an envelope was learned from, line by line, and its claims citing their lines.

The document is a DataFrame of lines with their bytes' places.  Lines are sorted by ranges and their places are prefix sums: within
a range by a window, over ranges by one row a range.  Neither a capsule list nor the text has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veristream.functions import exprs as X
from veristream.operators import envelope as E
from veristream.operators import verify as V
from veristream.operators.shared import checkpointed


def _fixed(rows: list[tuple[int, str]], spark) -> DataFrame:
    return spark.createDataFrame([(section, "", text) for section, text in rows], "section int, key string, line string")


def lines(capsules: DataFrame, bounds: DataFrame, generated: str, percentile: float = E.PERCENTILE, margin: float = E.MARGIN) -> DataFrame:
    """``section, key, line`` of ``name, sha256`` and ``action, sample_count, value, bound``: a header, a line for each capsule, one for
    each action.  Sections stand in order, and within one lines in order of their key's bytes."""
    spark = capsules.sparkSession
    head = ["BOUNDS COMPILER: TRAINING MANIFEST", "===================================", f"Generated: {generated}"]
    rest = [f"Percentile: {round(percentile * 100)}", f"Safety margin: {margin}", "---"]
    fixed = _fixed([*enumerate(head), *((4 + k, text) for k, text in enumerate(rest)), (8, "---")], spark)
    count = capsules.agg(F.count("*").alias("n")).select(F.lit(3).alias("section"), F.lit("").alias("key"), F.format_string("Capsules: %d", "n").alias("line"))
    named = capsules.select(F.lit(7).alias("section"), F.col("name").alias("key"), F.concat(F.lit("capsule: "), "name", F.lit(" sha256: "), "sha256").alias("line"))
    said = F.concat(F.lit("action: "), "action", F.lit(" frames: "), F.col("sample_count").cast("string"), F.lit(" p99_linf: "), X.fixed6(F.col("value")), F.lit(" bound: "), X.fixed6(F.col("bound")))
    return fixed.union(count).union(named).union(bounds.select(F.lit(9).alias("section"), F.col("action").alias("key"), said.alias("line")))


def placed(rows: DataFrame) -> DataFrame:
    """Add ``byte_start, byte_end``: where each line stands in the document, a line feed behind each."""
    order = [F.col("section"), F.col("key"), F.col("line")]
    size: Column = F.octet_length("line") + 1
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(F.col("_part").alias("_p")).agg(F.sum(size).alias("_size")).select("_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    upto = F.sum(size).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("_upto", upto).join(parts, F.col("_part") == F.col("_p"))
    end = F.col("_upto") + F.col("_before") - 1
    return found.select("section", "key", "line", (end - F.octet_length("line")).alias("byte_start"), end.alias("byte_end"))


def source_hash(document: DataFrame) -> DataFrame:
    """One row ``source_hash``: the Merkle root of the document's lines in order, as a hash of all its bytes would take one task."""
    leaves = document.select(F.lit(1).alias("g"), F.format_string("%020d", "byte_start").alias("place"), F.sha2("line", 256).alias("h"))
    return V.merkle_roots(leaves, "g", "place", "h").select(F.col("root").alias("source_hash"))


def graph(document: DataFrame, bounds: DataFrame, margin: float = E.MARGIN) -> dict[str, DataFrame]:
    """``claims``, ``spans`` and ``provenance`` of an envelope: each of its claims cites the line of its action."""
    claims = E.as_claims(bounds, margin=margin)
    claims = claims.withColumn("claim_id", X.deterministic_id("c_", F.col("subject"), F.col("predicate"), F.col("object"), F.col("object_type")))
    of = document.where("section = 9").crossJoin(F.broadcast(source_hash(document)))  # the hash is one row
    of = of.withColumn("span_id", X.deterministic_id("s_", F.col("source_hash"), F.col("byte_start").cast("string"), F.col("byte_end").cast("string"), F.col("line")))
    cited = claims.join(of.withColumn("subject", F.concat(F.lit("bounds/"), "key")), "subject")
    return {
        "claims": claims.select("claim_id", "subject", "predicate", "object", "object_type", "tier"),
        "spans": of.select("span_id", "source_hash", "byte_start", "byte_end", F.col("line").alias("text")),
        "provenance": cited.select(X.deterministic_id("p_", F.col("claim_id"), F.col("span_id")).alias("provenance_id"), "claim_id", "span_id", "source_hash", "byte_start", "byte_end"),
    }
