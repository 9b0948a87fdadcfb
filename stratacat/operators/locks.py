"""Locks and what they refer to: merge, versions, keep and preserve sets, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_versions(first: Column, second: Column) -> Column:
    """Both arrays' values in order, once each, without empty ones; null if none is left."""
    out = F.array_distinct(F.filter(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))), lambda x: x != ""))
    return F.when(F.size(out) > 0, out)


def merge(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row a path. Equal content: our row, deleted only if both are. Else the later push, then the greater hash, wins; its versions come first. pushed_at_s and versions are used where present."""
    cols = [c for c in ours.columns if c in theirs.columns and c != "path"]
    both = ours.select("path", F.struct(*cols).alias("o")).join(theirs.select("path", F.struct(*cols).alias("t")), "path", "full")
    o, t = F.col("o"), F.col("t")
    same = o["sha256"] == t["sha256"]
    wins = F.struct(t["pushed_at_s"], t["sha256"]) > F.struct(o["pushed_at_s"], o["sha256"])
    row = F.when(o.isNull(), t).when(t.isNull() | same | ~wins, o).otherwise(t)
    pick = lambda c: row[c]
    out = {c: pick(c) for c in cols}
    out["deleted"] = F.when(o.isNotNull() & t.isNotNull() & same, o["deleted"] & t["deleted"]).otherwise(row["deleted"])
    if "versions" in cols:
        out["versions"] = F.when(o.isNotNull() & t.isNotNull() & ~same & wins, union_versions(t["versions"], o["versions"])).otherwise(union_versions(o["versions"], t["versions"]))
    return both.select("path", *[out[c].alias(c) for c in cols])


def with_versions(lock: DataFrame, versions: DataFrame) -> DataFrame:
    """lock with the array versions of its path's rows (path, pos, sha256), newest first; null if it has none."""
    v = versions.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sha256"))), lambda x: x["sha256"]).alias("versions"))
    return lock.join(v, "path", "left")


def referenced(lock: DataFrame, versions: DataFrame, preserved_only: bool = False) -> DataFrame:
    """Distinct sha256 of entries, tombstones too, and of their versions."""
    rows = lock.where("preserve") if preserved_only else lock
    v = versions.join(rows.select("path"), "path", "left_semi").select("sha256")
    return rows.select("sha256").union(v).where("sha256 <> ''").distinct()


def paths_of(lock: DataFrame, versions: DataFrame) -> DataFrame:
    """sha256, n_paths, first_path: the paths that refer to a content; a path counts once."""
    rows = lock.select("path", "sha256").union(versions.select("path", "sha256")).distinct()
    return rows.groupBy("sha256").agg(F.count("*").alias("n_paths"), F.min("path").alias("first_path"))


def corrupt(objects: DataFrame) -> DataFrame:
    return objects.where("observed_sha <> object_key").select("object_key", "observed_sha")


def missing(lock: DataFrame, versions: DataFrame, objects: DataFrame) -> DataFrame:
    """sha256, n_paths, first_path of contents that are referred to but not stored."""
    return paths_of(lock, versions).join(objects.select(F.col("object_key").alias("sha256")), "sha256", "left_anti")


def revert_check(wanted: DataFrame, lock: DataFrame, versions: DataFrame) -> DataFrame:
    """path, sha256, verdict for wanted (path, sha256): no-entry, history-off, not-a-version, current or ok."""
    j = wanted.join(lock.select("path", F.col("sha256").alias("now"), "history", "deleted"), "path", "left").join(versions.select("path", "sha256", F.lit(True).alias("listed")).distinct(), ["path", "sha256"], "left")
    v = F.when(F.col("now").isNull() | F.col("deleted"), "no-entry").when(~F.col("history"), "history-off").when(F.col("now") == F.col("sha256"), "current").when(F.col("listed").isNull(), "not-a-version").otherwise("ok")
    return j.select("path", "sha256", v.alias("verdict"))


def version_history(log: DataFrame) -> DataFrame:
    """path, pos, sha256: of a path's contents in the order of at those that differ from the one before, newest first."""
    w = Window.partitionBy("path")
    new = log.withColumn("was", F.lag("sha256").over(w.orderBy("at"))).where(~F.col("sha256").eqNullSafe(F.col("was")))
    return new.select("path", (F.row_number().over(w.orderBy(F.desc("at"))) - 1).alias("pos"), "sha256")
