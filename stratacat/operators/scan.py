"""Catalog against disk, and lock against catalog against disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exit codes of findings; others have 0 and the greatest counts.
SEVERITY = {"chain-broken": 6, "corrupt": 5, "missing-on-disk": 5, "genesis-invalid": 5, "field-mismatch": 5, "lock-only": 5, "catalog-missing": 5}


def drift() -> F.Column:
    """Of a file with other content than recorded: edited if its size or time moved, else suspect."""
    return F.when((F.col("disk_size") != F.col("size")) | (F.col("mtime_s") > F.col("last_scanned_s")), "edited").otherwise("suspect")


def _beside(catalog: DataFrame, disk: DataFrame) -> DataFrame:
    c = catalog.select("path", F.col("sha256").alias("was"), "size", "sync_mode", "last_scanned_s")
    return c.join(disk.select("path", F.col("sha256").alias("now"), F.col("size").alias("disk_size"), "mtime_s"), "path", "full")


def diff(catalog: DataFrame, disk: DataFrame, paranoid: bool = False) -> DataFrame:
    """path, kind, sha256, old_path: deleted, edited, suspect, verified, added or moved. Rows that git keeps only stop "added"; unless paranoid, rows whose size and time didn't move aren't looked at."""
    j = _beside(catalog, disk).where(F.col("sync_mode").isNull() | (F.col("sync_mode") != "git"))
    touched = F.lit(paranoid) | (F.col("disk_size") != F.col("size")) | (F.col("mtime_s") > F.col("last_scanned_s"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(~touched, None).when(F.col("now") == F.col("was"), "verified").otherwise(drift())
    found = j.select("path", kind.alias("kind"), F.coalesce("now", "was").alias("sha256")).where("kind is not null")
    return pair_moves(found)


def pair_moves(found: DataFrame) -> DataFrame:
    """A deleted and an added row of one content, each the only one of its kind, become one moved row with old_path. Counts by content combine before the shuffle; contents that many rows have don't pair."""
    n = lambda k: F.count_if(F.col("kind") == k)
    pairs = found.where("kind in ('added', 'deleted')").groupBy("sha256").agg(n("added").alias("a"), n("deleted").alias("d"), F.max(F.when(F.col("kind") == "deleted", F.col("path"))).alias("old")).where("a = 1 and d = 1").select("sha256", "old")
    f = found.join(pairs, "sha256", "left")
    moved = F.col("old").isNotNull() & (F.col("kind") == "added")
    return f.where("old is null or kind <> 'deleted'").select("path", F.when(moved, "moved").otherwise(F.col("kind")).alias("kind"), "sha256", F.when(moved, F.col("old")).alias("old_path"))


def counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("kind").agg(F.count("*").alias("n"))


def three_way(lock: DataFrame, catalog: DataFrame, disk: DataFrame, pending: DataFrame, certified: F.Column) -> DataFrame:
    """path, kind for every disagreement of lock, catalog and disk.

    A row with an intent under way is pending-op and nothing else; then genesis-invalid, alone too. Others may have field-mismatch twice (content, id) or catalog-only,
    and missing-on-disk, edited-since-scan or corrupt where git doesn't keep them. Lock rows without a catalog row are lock-only. lock's id: null or empty where it has none.
    """
    c = catalog.withColumn("certified", certified).join(pending.select("id", F.lit(True).alias("busy")).distinct(), "id", "left")
    c = c.join(lock.select("path", F.col("sha256").alias("l_sha"), F.col("id").alias("l_id")), "path", "left")
    c = c.join(disk.select("path", F.col("sha256").alias("now"), F.col("size").alias("disk_size"), "mtime_s"), "path", "left")
    git = F.col("sync_mode") == "git"
    first = F.when(F.col("busy"), "pending-op").when(~F.col("certified"), "genesis-invalid")
    sha = F.when(F.col("l_sha").isNull() & ~git, "catalog-only").when(F.col("l_sha") != F.col("sha256"), "field-mismatch")
    ident = F.when((F.coalesce("l_id", F.lit("")) != "") & (F.col("l_id") != F.col("id")), "field-mismatch")
    on_disk = F.when(git, None).when(F.col("now").isNull(), "missing-on-disk").when(F.col("now") == F.col("sha256"), None).when(drift() == "edited", "edited-since-scan").otherwise("corrupt")
    kinds = F.when(first.isNotNull(), F.array(first)).otherwise(F.array(sha, ident, on_disk))
    rows = c.select("path", F.explode(kinds).alias("kind")).where("kind is not null")
    alone = lock.select("path").join(catalog.select("path"), "path", "left_anti").select("path", F.lit("lock-only").alias("kind"))
    return rows.unionByName(alone)


def worst(findings: DataFrame) -> DataFrame:
    """exit_code: the greatest severity."""
    code = F.lit(0)
    for k, v in SEVERITY.items():
        code = F.when(F.col("kind") == k, v).otherwise(code)
    return findings.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))


def to_operations(changes: DataFrame) -> DataFrame:
    """path, op_type, args of the log entries that changes call for; suspect ones aren't applied and verified ones only move the scan time."""
    op = F.when(F.col("kind") == "added", "ingest").when(F.col("kind") == "edited", "scan").when(F.col("kind") == "moved", "move").when(F.col("kind") == "deleted", "delete")
    args = F.when(op == "ingest", F.create_map(F.lit("path"), F.col("path"), F.lit("content_sha256"), F.col("sha256"))).when(op == "scan", F.create_map(F.lit("path"), F.col("path"), F.lit("new_sha256"), F.col("sha256"))).when(op == "move", F.create_map(F.lit("from"), F.col("old_path"), F.lit("to"), F.col("path"))).when(op == "delete", F.create_map(F.lit("path"), F.col("path")))
    return changes.select("path", op.alias("op_type"), args.alias("args")).where("op_type is not null")


def parts(path: str = "path") -> tuple[F.Column, F.Column]:
    """stem and extension (with its dot; none for a name that starts with its only dot)."""
    ext = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    return F.substring(F.col(path), 1, F.length(path) - F.length(ext)), ext


def used_numbers(paths: DataFrame) -> DataFrame:
    """stem, ext, used: the n from 2 of the paths `stem (n).ext`, sorted."""
    rx = r"^(.*) \(([0-9]{1,9})\)((?:\.[^./]*)?)$"
    n = paths.select("path").where(F.col("path").rlike(rx)).select(F.regexp_extract("path", rx, 1).alias("stem"), F.regexp_extract("path", rx, 3).alias("ext"), F.regexp_extract("path", rx, 2).alias("t"))
    return n.where(F.col("t") == F.col("t").cast("int").cast("string")).where("cast(t as int) >= 2").groupBy("stem", "ext").agg(F.sort_array(F.collect_set(F.col("t").cast("int"))).alias("used"))


def nth_free(used: F.Column, k: F.Column) -> F.Column:
    """The k-th number from 2, k from 1, that the sorted array used doesn't have."""
    return F.aggregate(F.coalesce(used, F.array().cast("array<int>")), k.cast("int") + 1, lambda n, u: F.when(u <= n, n + 1).otherwise(n))


def numbered(stem: F.Column, n: F.Column, ext: F.Column) -> F.Column:
    return F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext)


def free_names(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """path, free: the path itself if no row has it, else `stem (n).ext` with the smallest n from 2 that is free."""
    stem, ext = parts()
    taken = catalog.select("path", F.lit(True).alias("taken")).distinct()
    j = wanted.select("path", stem.alias("stem"), ext.alias("ext")).join(taken, "path", "left").join(used_numbers(catalog), ["stem", "ext"], "left")
    return j.select("path", F.when(F.col("taken"), numbered(F.col("stem"), nth_free(F.col("used"), F.lit(1)), F.col("ext"))).otherwise(F.col("path")).alias("free"))
