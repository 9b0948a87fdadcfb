"""Finding, ordering and adding up rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_path(catalog: DataFrame, member: str, path: str) -> DataFrame:
    """The row of one path of one member; none if there is none."""
    return catalog.where((F.col("member") == member) & (F.col("path") == path)).limit(1)


def first_by(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row a key, the one with the smallest pos. A combining aggregate."""
    cols = [c for c in rows.columns if c not in (key, pos)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), pos).alias("x")).select(key, "x.*")


def last_by(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """One row a key, the one with the greatest pos: what a map has that is filled in that order."""
    cols = [c for c in rows.columns if c not in (key, pos)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), pos).alias("x")).select(key, "x.*")


def find(wanted: DataFrame, rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """wanted (key) with found and the columns of the first row that has the key; null columns where none has."""
    hit = first_by(rows.join(wanted.select(key).distinct(), key, "left_semi"), key, pos).withColumn("found", F.lit(True))
    return wanted.join(hit, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exists(wanted: DataFrame, objects: DataFrame) -> DataFrame:
    """object_key, there, size of wanted keys: an absent key is an answer, not an error."""
    return wanted.join(objects.select("object_key", F.lit(True).alias("t"), "size"), "object_key", "left").select("object_key", F.coalesce("t", F.lit(False)).alias("there"), "size")


def total_bytes(plan: DataFrame) -> DataFrame:
    """n_files, n_bytes of a plan's rows (size)."""
    return plan.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_bytes"))


def progress(listing: DataFrame) -> DataFrame:
    """member, path, done_bytes, done_files: how far a walk in the order of path has come with each file of a member.

    Ranges of paths are added up side by side: each range has a first sum, and what lies before it comes from the few sums of the ranges.
    """
    from pyspark.sql import Window

    spread = listing.select("member", "path", "size").repartitionByRange("member", "path").withColumn("part", F.spark_partition_id())
    sums = spread.groupBy("member", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    above = Window.partitionBy("member").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("member", "part", F.coalesce(F.sum("b").over(above), F.lit(0)).alias("b"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n"))
    within = Window.partitionBy("member", "part").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    own = spread.select("member", "part", "path", F.sum("size").over(within).alias("own_b"), F.count("*").over(within).alias("own_n"))
    return own.join(before, ["member", "part"]).select("member", "path", (F.col("own_b") + F.col("b")).cast("long").alias("done_bytes"), (F.col("own_n") + F.col("n")).alias("done_files"))


def by_name(members: DataFrame) -> DataFrame:
    """In the order of name; equal names in that of joined_at_s."""
    return members.orderBy("name", "joined_at_s")


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """A result in its canonical order: status by path, listings by logical path, plans by key."""
    return rows.orderBy(*keys)


def sample(rows: DataFrame, key: str, most: int = 10) -> DataFrame:
    """The first rows by key, most at most, with more: how many others there are."""
    n = rows.count()
    return rows.orderBy(key).limit(most).select(key, F.lit(max(0, n - most)).cast("long").alias("more"))


def deselect(candidates: DataFrame, chosen: DataFrame, key: str = "path") -> DataFrame:
    """candidates with index, their place from 1 in the order of key, without those that chosen (index) takes out."""
    from pyspark.sql import Window

    ranged = candidates.repartitionByRange(key).withColumn("part", F.spark_partition_id())
    sums = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a range
    placed = ranged.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(key))).join(before, "part").withColumn("index", F.col("own") + F.col("before"))
    return placed.drop("part", "own", "before").join(chosen.select(F.col("index").cast("long")), "index", "left_anti")


def ok(problems: Column | DataFrame) -> DataFrame:
    """ok: whether a report names no problem."""
    return problems.agg((F.count("*") == 0).alias("ok"))
