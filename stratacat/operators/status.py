"""Working tree against lock: status, push, pull, clean and smudge plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(tree: DataFrame, lock: DataFrame) -> DataFrame:
    """path, state, sha256: local-only, pushed, drifted or orphaned. A tombstone counts as absent, and without a file gives no row."""
    j = tree.select("path", F.col("sha256").alias("t")).join(lock.select("path", F.col("sha256").alias("l"), "deleted"), "path", "full")
    live = F.col("l").isNotNull() & ~F.coalesce("deleted", F.lit(False))
    state = F.when(~live, "local-only").when(F.col("t").isNull(), "orphaned").when(F.col("t") == F.col("l"), "pushed").otherwise("drifted")
    return j.where(F.col("t").isNotNull() | live).select("path", state.alias("state"), F.coalesce("t", "l").alias("sha256"))


def blob_missing(tree: DataFrame, lock: DataFrame, objects: DataFrame) -> DataFrame:
    """path, sha256 of pushed files whose object isn't there. Each hash is looked up once."""
    pushed = tree.select("path", "sha256").join(lock.where("not deleted").select("path", "sha256"), ["path", "sha256"])
    gone = pushed.select("sha256").distinct().join(objects.select(F.col("object_key").alias("sha256")), "sha256", "left_anti")
    return pushed.join(gone, "sha256", "left_semi").select("path", "sha256")


def renames(tree: DataFrame, lock: DataFrame) -> DataFrame:
    """old_path, new_path, sha256: a path that the lock doesn't know takes over the entry of a live path with its content that is gone from the tree.

    In the order of new paths each takes the smallest old path that is left; equal ranks within a hash are the same pairs.
    """
    rank = lambda: F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    new = tree.select("path", "sha256").join(lock.select("path"), "path", "left_anti").withColumn("rank", rank())
    old = lock.where("not deleted").select("path", "sha256").join(tree.select("path"), "path", "left_anti").withColumn("rank", rank())
    return old.withColumnRenamed("path", "old_path").join(new.withColumnRenamed("path", "new_path"), ["sha256", "rank"]).select("old_path", "new_path", "sha256")


def push_plan(tree: DataFrame, lock: DataFrame, objects: DataFrame, auto_delete: bool = True) -> DataFrame:
    """path, action, sha256, old_sha256, gc: what a push would do with each path of tree or lock.

    unchanged, renamed, deduped (the object is there) or uploaded for the tree; renamed-away, tombstone (kept as it is), dropped (its object goes to GC: gc) or
    tombstoned for the rest. gc also marks a path whose superseded content no history or preserve flag holds.
    """
    moved = renames(tree, lock)
    t, l = tree.select("path", F.col("sha256").alias("t")), lock.select("path", F.col("sha256").alias("l"), "deleted", "history", "preserve")
    j = t.join(l, "path", "full").join(moved.select(F.col("new_path").alias("path"), F.lit(True).alias("to")), "path", "left").join(moved.select(F.col("old_path").alias("path"), F.lit(True).alias("away")), "path", "left")
    j = j.join(objects.select(F.col("object_key").alias("t"), F.lit(True).alias("there")), "t", "left")
    action = (
        F.when(F.col("t").isNotNull() & (F.col("t") == F.col("l")) & ~F.col("deleted"), "unchanged")
        .when(F.col("t").isNotNull() & F.col("to"), "renamed")
        .when(F.col("t").isNotNull() & F.col("there"), "deduped")
        .when(F.col("t").isNotNull(), "uploaded")
        .when(F.col("away"), "renamed-away")
        .when(F.col("deleted"), "tombstone")
        .when(F.lit(auto_delete) & ~F.col("preserve"), "dropped")
        .otherwise("tombstoned")
    )
    p = j.select("path", action.alias("action"), F.coalesce("t", "l").alias("sha256"), F.col("l").alias("old_sha256"), "history", "preserve")
    superseded = F.col("action").isin("deduped", "uploaded") & F.col("old_sha256").isNotNull() & (F.col("old_sha256") != F.col("sha256")) & ~F.col("history") & ~F.col("preserve")
    return p.select("path", "action", "sha256", "old_sha256", F.coalesce((F.col("action") == "dropped") | superseded, F.lit(False)).alias("gc"))


def pull_plan(tree: DataFrame, lock: DataFrame) -> DataFrame:
    """path, sha256, location of live entries that the tree doesn't hold as they should be."""
    return lock.where("not deleted").select("path", "sha256", "location").join(tree.select("path", "sha256"), ["path", "sha256"], "left_anti")
