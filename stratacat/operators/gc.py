"""Garbage collection plans. They delete nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Unanswered(RuntimeError):
    """A member that the plan needs didn't answer."""


def mark(objects: DataFrame, keep: DataFrame, preserve: DataFrame | None = None) -> DataFrame:
    """object_key, verdict: kept before preserved before eligible."""
    has = lambda s, n: s.select(F.col("sha256").alias("object_key"), F.lit(True).alias(n)).distinct()
    j = objects.select("object_key").join(has(keep, "k"), "object_key", "left")
    j = j.join(has(preserve, "p"), "object_key", "left") if preserve is not None else j.withColumn("p", F.lit(None).cast("boolean"))
    return j.select("object_key", F.when(F.col("k"), "kept").when(F.col("p"), "preserved").otherwise("eligible").alias("verdict"))


def gate(members: DataFrame) -> None:
    """Raises Unanswered, naming a few, unless every active member answered. One small action before any plan."""
    down = [r["name"] for r in members.where("status = 'active' and not answered").select("name").orderBy("name").limit(10).collect()]
    if down:
        raise Unanswered(", ".join(down))


def mark_federated(objects: DataFrame, catalog: DataFrame, keep: DataFrame, preserve: DataFrame, pending: DataFrame) -> DataFrame:
    """mark for the objects of git-mode rows only; an eligible one whose id has an intent under way is pending. Other modes, known or not, are never candidates."""
    git = catalog.where("sync_mode = 'git'").groupBy("sha256").agg(F.max_by("id", "path").alias("id"))
    m = mark(objects.join(git.select(F.col("sha256").alias("object_key")), "object_key", "left_semi"), keep, preserve)
    j = m.join(git.select(F.col("sha256").alias("object_key"), "id"), "object_key").join(pending.select("id", F.lit(True).alias("busy")).distinct(), "id", "left")
    return j.select("object_key", F.when((F.col("verdict") == "eligible") & F.col("busy"), "pending").otherwise(F.col("verdict")).alias("verdict"))


def sweep(objects: DataFrame, plan: DataFrame) -> DataFrame:
    """objects without the eligible ones of a plan."""
    return objects.join(plan.where("verdict = 'eligible'").select("object_key"), "object_key", "left_anti")


def forget(catalog: DataFrame, doomed: DataFrame) -> DataFrame:
    """catalog without any row, whatever its mode, of the doomed sha256."""
    return catalog.join(doomed.select("sha256").distinct(), "sha256", "left_anti")


def reference_counts(catalog: DataFrame) -> DataFrame:
    """member, sha256, n, last: how many rows of a member share a content; removing one deletes the bytes only where it is the last."""
    return catalog.groupBy("member", "sha256").agg(F.count("*").alias("n")).withColumn("last", F.col("n") <= 1)
