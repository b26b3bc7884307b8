"""Envelopes: a percentile bound on the norm of each action, as a table, as claims, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veristream.functions import exprs as X

PERCENTILE, MARGIN = 0.99, 1.1


#: Ranks that a sketch of a group's norms tells apart.
SKETCH = 10_000


def learn(frames: DataFrame, percentile: float = PERCENTILE, margin: float = MARGIN) -> DataFrame:
    """``action, sample_count, bound`` from ``action, norm``: the exact percentile and a margin."""
    return percentiles(frames, percentile).select("action", "sample_count", F.round(F.col("value") * margin, 6).alias("bound"))


def percentiles(frames: DataFrame, percentile: float = PERCENTILE) -> DataFrame:
    """``action, sample_count, value`` from ``action, norm``: the exact percentile, between the two neighbouring ranks.  Non-finite
    norms don't count.

    A sketch of each action's norms brackets both ranks; a second pass counts the norms below the bracket and each value in it, before
    anything is shuffled.  What one task sorts of an action is the values in its bracket, four parts in ``SKETCH`` of its rows.  The
    job fails if a rank lay outside, which the sketch's bound excludes."""
    norms = frames.where(X.is_finite(F.col("norm"))).select("action", "norm")
    around = [max(0.0, percentile - 2 / SKETCH), min(1.0, percentile + 2 / SKETCH)]
    # One rank more on either side: a group may have few rows.
    bracket = norms.groupBy("action").agg(F.count("*").alias("sample_count"), F.percentile_approx("norm", around, SKETCH).alias("q"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    few = F.col("sample_count") <= SKETCH
    low, high = F.when(few, F.col("least")).otherwise(F.col("q")[0]), F.when(few, F.col("most")).otherwise(F.col("q")[1])
    bracket = bracket.select(F.col("action").alias("name"), "sample_count", ((F.col("sample_count") - 1) * percentile).alias("rank"), low.alias("low"), high.alias("high"))
    met = norms.join(bracket, F.col("action").eqNullSafe(F.col("name")) & (F.col("norm") <= F.col("high")))
    value = F.when(F.col("norm") >= F.col("low"), F.col("norm"))
    counted = met.groupBy("action", "sample_count", "rank", value.alias("value")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("action").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("upto", F.sum("n").over(upto))
    # The value at a rank is the first of which so many rows lie at or below it.
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.struct("upto", "value")))["value"]
    found = counted.groupBy("action").agg(F.first("sample_count").alias("sample_count"), F.first("rank").alias("rank"), at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    part = F.col("rank") - F.floor("rank")
    between = F.col("a") + (F.col("b") - F.col("a")) * part
    outside = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    return found.select("action", "sample_count", F.when(F.col("a").isNull() | F.col("b").isNull(), outside).otherwise(between).alias("value"))


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """The rows; the job fails if there are none, for what must not be granted by default (no deltas, no bounds, no claims)."""
    found = rows.limit(1).agg(F.count("*").alias("_some"))
    none = found.where(F.when(F.col("_some") > 0, F.lit(False)).otherwise(F.raise_error(F.lit(f"no {what}")).cast("boolean")))
    # A branch that never gives a row: it runs with the job that reads all rows, even if they are none.
    return rows.union(none.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields)))


def finite_counts(frames: DataFrame) -> DataFrame:
    """``action, kept, dropped``: how many norms are finite."""
    ok = F.coalesce(X.is_finite(F.col("norm")), F.lit(False))
    return frames.groupBy("action").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def complete(events: DataFrame) -> DataFrame:
    """Events that have an action and a reference; an empty action is none."""
    return events.where(F.col("action").isNotNull() & (F.col("action") != "") & F.col("ref").isNotNull())


def as_claims(envelope: DataFrame, percentile: float = PERCENTILE, margin: float = MARGIN) -> DataFrame:
    """Four claims of tier 0 for each action."""
    rows = [("bound", X.fixed6(F.col("bound")), "literal:decimal"), ("sample_count", F.col("sample_count").cast("string"), "literal:integer"), ("percentile", F.lit(str(round(percentile * 100))), "literal:integer"), ("safety_margin", X.fixed6(F.lit(margin)), "literal:decimal")]
    claims = F.array(*(F.struct(F.lit(p).alias("predicate"), o.alias("object"), F.lit(t).alias("object_type")) for p, o, t in rows))
    return envelope.select(F.concat(F.lit("bounds/"), "action").alias("subject"), F.explode(claims).alias("c")).select("subject", "c.*", F.lit(0).alias("tier"))


def from_claims(claims: DataFrame) -> DataFrame:
    """``action, bound, sample_count, max_tier``: the claims pivoted back.  A bound of another object type has no number and is null."""
    number = X.typed_number(F.col("object"), F.col("object_type"))
    own = claims.where(F.col("subject").startswith("bounds/")).withColumn("action", F.expr("substring(subject, 8)"))
    return own.groupBy("action").agg(F.max(F.when(F.col("predicate") == "bound", number)).alias("bound"), F.max(F.when(F.col("predicate") == "sample_count", number)).cast("long").alias("sample_count"), F.greatest(F.lit(0), F.max("tier")).alias("max_tier"))


def manifest_lines(envelope: DataFrame) -> DataFrame:
    """One row: a text with a line for each action, in order."""
    line = F.concat(F.lit("action: "), "action", F.lit(" samples: "), F.col("sample_count").cast("string"), F.lit(" bound: "), X.fixed6(F.col("bound")))
    lines = F.array_sort(F.collect_list(F.struct("action", line.alias("line"))))
    return envelope.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("manifest"))
