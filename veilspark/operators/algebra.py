"""Span algebra over rows (one row per finding): the relational forms of duplicate removal, merging and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_contained(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct findings (key, entity_type, start, end, score) without score 0 and without those inside a better one of the same type:
    an anti join on key and type. Better: higher score, then earlier start, then longer."""
    rows = df.select(key, "entity_type", "start", "end", "score").distinct().filter("score > 0")
    a, b = rows.alias("a"), rows.alias("b")
    inside = (F.col("a.start") >= F.col("b.start")) & (F.col("a.end") <= F.col("b.end"))
    rank = lambda t: F.struct((-F.col(f"{t}.score")).alias("s"), F.col(f"{t}.start").alias("b"), (F.col(f"{t}.start") - F.col(f"{t}.end")).alias("l"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.entity_type") == F.col("b.entity_type")) & inside & (rank("b") < rank("a")), "left_anti")


def merge_overlaps(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Overlapping findings of one type as one, with the largest score: gaps and islands by a running maximum of ends."""
    w = Window.partitionBy(key, "entity_type").orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__new", F.when(seen.isNull() | (F.col("start") >= seen), 1).otherwise(0))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "entity_type", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("__island")


def merge_adjacent(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Neighbours of one type with nothing but spaces (at least one) between them as one finding. Needs the text column."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before, kind = F.lag("end").over(w), F.lag("entity_type").over(w)
    joined = (kind == F.col("entity_type")) & F.substring(F.col(text), before + 1, F.col("start") - before).rlike("^ +$")
    rows = df.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "__island").agg(F.first("entity_type").alias("entity_type"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("__island")
