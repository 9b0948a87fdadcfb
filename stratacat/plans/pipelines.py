"""Data-changing commands as plans: each returns the tables as they would be, and what it did; nothing is written here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacat.functions import globs, identity
from stratacat.operators import federation, gc, locks, projection, scan, status, wal


@dataclass(frozen=True)
class Outcome:
    """table: the changed table; report: a row for each thing done or refused; intents: what goes to the log before anything is changed, where a command journals, and is marked done after."""

    table: DataFrame
    report: DataFrame
    intents: DataFrame | None = None


def push(tree: DataFrame, lock: DataFrame, objects: DataFrame, location: str, pushed_at_s: int, auto_delete: bool = True) -> Outcome:
    """The lock after a push. lock: path, sha256, size, location, pushed_at_s, history, preserve, deleted."""
    plan = status.push_plan(tree, lock, objects, auto_delete)
    cols = ["path", "sha256", "size", "location", "pushed_at_s", "history", "preserve", "deleted"]
    same = lock.select(*cols).join(plan.where("action in ('unchanged', 'tombstone')").select("path"), "path", "left_semi")
    dead = lock.select(*cols).join(plan.where("action = 'tombstoned'").select("path"), "path", "left_semi").withColumn("deleted", F.lit(True))
    moved = status.renames(tree, lock)
    carried = lock.withColumnRenamed("path", "old_path").join(moved.select("old_path", "new_path"), "old_path").withColumnRenamed("new_path", "path").select(*cols)
    new = plan.where("action in ('deduped', 'uploaded')").select("path").join(tree.select("path", "sha256", "size"), "path").join(lock.select("path", "history", "preserve"), "path", "left")
    new = new.select("path", "sha256", "size", F.lit(location).alias("location"), F.lit(pushed_at_s).cast("long").alias("pushed_at_s"), F.coalesce("history", F.lit(False)).alias("history"), F.coalesce("preserve", F.lit(False)).alias("preserve"), F.lit(False).alias("deleted"))
    return Outcome(same.unionByName(dead).unionByName(carried).unionByName(new), plan)


def revert(lock: DataFrame, versions: DataFrame, wanted: DataFrame) -> Outcome:
    """The lock with the entries of wanted (path, sha256) that pass revert_check pointing there."""
    report = locks.revert_check(wanted, lock, versions)
    ok = report.where("verdict = 'ok'").select("path", F.col("sha256").alias("__to"))
    return Outcome(lock.join(ok, "path", "left").withColumn("sha256", F.coalesce("__to", "sha256")).drop("__to").select(*lock.columns), report)


def collect_garbage(objects: DataFrame, catalog: DataFrame, keep: DataFrame, preserve: DataFrame, pending: DataFrame, members: DataFrame) -> Outcome:
    """The catalog after a federated collection. Refuses before any work unless every active member answered."""
    gc.gate(members)
    plan = gc.mark_federated(objects, catalog, keep, preserve, pending)
    doomed = plan.where("verdict = 'eligible'").select(F.col("object_key").alias("sha256"))
    return Outcome(gc.forget(catalog, doomed), plan)


def absorb_scan(catalog: DataFrame, disk: DataFrame, confirmed: DataFrame | None = None) -> Outcome:
    """What a scan would journal; deletions only of the paths in confirmed, if that is given."""
    found = scan.diff(catalog, disk)
    if confirmed is not None:
        found = found.where("kind <> 'deleted'").unionByName(found.where("kind = 'deleted'").join(confirmed.select("path"), "path", "left_semi"))
    return Outcome(scan.to_operations(found), found)


def rebuild(log: DataFrame) -> Outcome:
    """The catalog that a log says; members whose chain is broken are withheld and reported."""
    breaks = wal.chain_breaks(log)
    return Outcome(projection.project(log.join(breaks.select("member").distinct(), "member", "left_anti")), breaks)


def ingest(listing: DataFrame, member: str, seen: DataFrame) -> DataFrame:
    """member, op_id, path, id, args of the ingest operations for the files of a listing (path, sha256, size) that seen (op_id) doesn't have: a second run finds none."""
    op = identity.op_id(F.lit("ingest"), F.lit(member), F.col("path"), F.col("sha256"))
    g = lambda: {"content_sha256": F.col("sha256"), "original_path": F.col("path"), "ingest_op_id": F.col("op_id"), "origin_node": F.lit(member)}
    rows = listing.withColumn("op_id", op).join(seen.select("op_id"), "op_id", "left_anti")
    args = F.create_map(F.lit("content_sha256"), F.col("sha256"), F.lit("path"), F.col("path"), F.lit("size"), F.col("size").cast("string"))
    return rows.select(F.lit(member).alias("member"), "op_id", "path", identity.mint_id(g()).alias("id"), args.alias("args"))


def track(paths: DataFrame, catalog: DataFrame, disk: DataFrame) -> DataFrame:
    """path, verdict: missing, tracked (new), already or drifted. With the column position, the first missing path ends the run: later ones are not-reached."""
    j = paths.join(catalog.select("path", F.col("sha256").alias("was")), "path", "left").join(disk.select("path", F.col("sha256").alias("now")), "path", "left")
    v = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "tracked").when(F.col("was") == F.col("now"), "already").otherwise("drifted")
    if "position" not in paths.columns:
        return j.select("path", v.alias("verdict"))
    stop = j.agg(F.min(F.when(F.col("now").isNull(), F.col("position"))).alias("stop"))
    return j.join(stop, F.lit(True)).select("path", F.when(F.col("position") > F.col("stop"), "not-reached").otherwise(v).alias("verdict"))  # one row on the right


def set_sync_mode(catalog: DataFrame, wanted: DataFrame, settable: tuple[str, ...] = ("git", "manual"), objects: DataFrame | None = None) -> Outcome:
    """The catalog with the modes of wanted (path, to_mode); report: no-file, not-settable, same, no-bytes, rehomed or changed.

    With objects (object_key, observed_sha), a file that git is to keep is hashed first: without bytes it stays as it is, and other bytes than recorded take the row to their own hash.
    """
    now = F.col("observed_sha") if objects is not None else F.lit(None).cast("string")
    j = wanted.join(catalog.select("path", "sync_mode", "sha256"), "path", "left")
    if objects is not None:
        j = j.join(objects.select(F.col("object_key").alias("sha256"), "observed_sha"), "sha256", "left")
    to_git = F.lit(objects is not None) & (F.col("to_mode") == "git")
    v = F.when(F.col("sync_mode").isNull(), "no-file").when(~F.col("to_mode").isin(*settable), "not-settable").when(F.col("to_mode") == F.col("sync_mode"), "same").when(to_git & now.isNull(), "no-bytes").when(to_git & (now != F.col("sha256")), "rehomed").otherwise("changed")
    report = j.select("path", "to_mode", v.alias("verdict"), F.when(v == "rehomed", now).alias("new_sha256"))
    to = report.where("verdict in ('changed', 'rehomed')").select("path", "to_mode", "new_sha256")
    table = catalog.join(to, "path", "left").withColumn("sync_mode", F.coalesce("to_mode", "sync_mode")).withColumn("sha256", F.coalesce("new_sha256", "sha256"))
    return Outcome(table.select(*catalog.columns), report)


def move(catalog: DataFrame, moves: DataFrame) -> Outcome:
    """The catalog of members after moves (member, path, to_member, to_path); ids stay. A move without a source, or onto a path that is taken or that an earlier move takes, is refused."""
    from pyspark.sql import Window

    there = catalog.select(F.col("member").alias("to_member"), F.col("path").alias("to_path"), F.lit(True).alias("taken"))
    rank = F.row_number().over(Window.partitionBy("to_member", "to_path").orderBy("member", "path"))
    j = moves.join(catalog.select("member", "path", F.lit(True).alias("held")), ["member", "path"], "left").join(there, ["to_member", "to_path"], "left").withColumn("rank", rank)
    v = F.when(F.col("held").isNull(), "no-file").when(F.col("taken") | (F.col("rank") > 1), "conflict").otherwise("moved")
    report = j.select("member", "path", "to_member", "to_path", v.alias("verdict"))
    ok = report.where("verdict = 'moved'").drop("verdict")
    c = catalog.join(ok, ["member", "path"], "left").withColumn("path", F.coalesce("to_path", "path")).withColumn("member", F.coalesce("to_member", "member"))
    return Outcome(c.select(*catalog.columns), report)


def restore_identity(catalog: DataFrame, wanted: DataFrame) -> Outcome:
    """The catalog with restored ids. wanted: path, restored_id and the record's four fields; report: not-certified, no-file, already, collision or restored."""
    g = {k: F.col(f"w_{k}") for k in identity.GENESIS}
    w = wanted.select("path", "restored_id", *[F.col(k).alias(f"w_{k}") for k in identity.GENESIS])
    j = w.join(catalog.select("path", F.col("id").alias("now")), "path", "left").join(catalog.select(F.col("id").alias("restored_id"), F.lit(True).alias("used")).distinct(), "restored_id", "left")
    v = F.when(~identity.certifies(g, F.col("restored_id")), "not-certified").when(F.col("now").isNull(), "no-file").when(F.col("now") == F.col("restored_id"), "already").when(F.col("used"), "collision").otherwise("restored")
    j = j.withColumn("verdict", v)
    ok = j.where("verdict = 'restored'").select("path", "restored_id", *[f"w_{k}" for k in identity.GENESIS])
    c = catalog.join(ok, "path", "left")
    for k in identity.GENESIS:
        c = c.withColumn(k, F.coalesce(f"w_{k}", k)) if k in catalog.columns else c
    return Outcome(c.withColumn("id", F.coalesce("restored_id", "id")).select(*catalog.columns), j.select("path", "restored_id", "verdict"))


def clean(content: Column, path: Column, size: Column, location: str, magic: str, **rules) -> Column:
    """A managed file's pointer in the place of its content; other content as it is."""
    managed = globs.evaluate(path, size, **rules)["managed"]
    return F.when(managed & ~identity.is_pointer(content.cast("string"), magic), identity.pointer_text(F.sha2(content, 256), size, F.lit(location), magic)).otherwise(content.cast("string"))


def smudge(pointers: DataFrame, objects: DataFrame) -> DataFrame:
    """path, content, verdict for pointers (path, sha256, size) and objects (object_key, content): missing, corrupt, size or ok; content only where ok."""
    j = pointers.join(objects.select(F.col("object_key").alias("sha256"), "content"), "sha256", "left")
    v = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("sha256"), "corrupt").when(F.octet_length("content") != F.col("size"), "size").otherwise("ok")
    return j.select("path", F.when(v == "ok", F.col("content")).alias("content"), v.alias("verdict"))


def put(catalog: DataFrame, rows: DataFrame, conflict: str | None = "stop") -> Outcome:
    """The catalog with rows added; report: path, rank, final_path, verdict. A path is free for the first new row that has it, if no row of the catalog does.

    Another row on it is, by conflict: stop: refused; copy: copied, each to its own first free `name (n)`, where names that other new rows ask for count as taken; rename: renamed to the row's rename_to,
    or needs-name where it has none, or refused where that is taken or asked for; None, as without a terminal to ask: undecided. Rows of a path rank by all their columns.
    """
    from pyspark.sql import Window

    cols = catalog.columns
    to = F.nullif(F.trim("rename_to"), F.lit("")) if "rename_to" in rows.columns else F.lit(None).cast("string")
    stem, ext = scan.parts()
    r = rows.select(*cols, to.alias("__to"), F.row_number().over(Window.partitionBy("path").orderBy(*[c for c in cols if c != "path"])).alias("__rank"), stem.alias("stem"), ext.alias("ext"))
    names = catalog.select("path").union(rows.select("path")).distinct()
    r = r.join(catalog.select("path", F.lit(True).alias("__there")).distinct(), "path", "left").join(scan.used_numbers(names), ["stem", "ext"], "left")
    free, nth = F.col("__there").isNull() & (F.col("__rank") == 1), F.col("__rank") - F.when(F.col("__there"), 0).otherwise(1)
    if conflict == "copy":
        final, verdict = scan.numbered(F.col("stem"), scan.nth_free(F.col("used"), nth), F.col("ext")), F.lit("copied")
    elif conflict == "rename":
        r = r.join(names.select(F.col("path").alias("__to"), F.lit(True).alias("__bad")), "__to", "left")
        turn = F.when(~free & F.col("__to").isNotNull(), F.row_number().over(Window.partitionBy("__to").orderBy(free, "path", "__rank")))
        r = r.withColumn("__turn", turn)
        final, verdict = F.col("__to"), F.when(F.col("__to").isNull(), "needs-name").when(F.col("__bad") | (F.col("__turn") > 1), "refused").otherwise("renamed")
    else:
        final, verdict = F.lit(None).cast("string"), F.lit("undecided" if conflict is None else "refused")
    d = r.withColumn("__verdict", F.when(free, "put").otherwise(verdict)).withColumn("__final", F.when(free, F.col("path")).when(F.col("__verdict").isin("copied", "renamed"), final))
    ok = d.where("__final is not null").select(*[F.col("__final").alias("path") if c == "path" else F.col(c) for c in cols])
    return Outcome(catalog.unionByName(ok), d.select("path", F.col("__rank").alias("rank"), F.col("__final").alias("final_path"), F.col("__verdict").alias("verdict")))


def roster_change(members: DataFrame, change: DataFrame, at_s: int) -> Outcome:
    """The roster after change (name, status): active joins or comes back, left and evicted take an active member out. Evicting a member that answers is refused."""
    j = change.withColumnRenamed("status", "to").join(members.select("name", "status", "answered"), "name", "left")
    v = F.when((F.col("to") == "evicted") & F.coalesce("answered", F.lit(False)), "refused-live").when((F.col("to") != "active") & F.coalesce(F.col("status") != "active", F.lit(True)), "not-active").otherwise("applied")
    report = j.select("name", F.col("to").alias("status"), v.alias("verdict"))
    ok = report.where("verdict = 'applied'").select("name", "status", F.lit(at_s).cast("long").alias("joined_at_s"))
    kept = members.join(ok.select("name"), "name", "left_anti").select("name", "status", F.lit(None).cast("long").alias("joined_at_s"))
    return Outcome(kept.unionByName(ok), report)


def remove(catalog: DataFrame, wanted: DataFrame, confirmed: bool) -> Outcome:
    """The catalog without the rows of wanted (member, path); report: no-file, unconfirmed, row (others of the member share the bytes) or bytes. Of rows of one content that go together the last takes the bytes."""
    from pyspark.sql import Window

    same = Window.partitionBy("member", "sha256")
    c = catalog.select("member", "path", "sha256").join(wanted.select("member", "path", F.lit(True).alias("go")).distinct(), ["member", "path"], "left")
    c = c.withColumn("stay", F.sum(F.when(F.col("go"), 0).otherwise(1)).over(same)).withColumn("rank", F.row_number().over(same.orderBy(F.coalesce("go", F.lit(False)).desc(), F.col("path").desc())))
    v = F.when(F.col("stay").isNull(), "no-file").when(F.lit(not confirmed), "unconfirmed").when((F.col("stay") == 0) & (F.col("rank") == 1), "bytes").otherwise("row")
    report = wanted.select("member", "path").distinct().join(c.where("go").select("member", "path", "stay", "rank"), ["member", "path"], "left").select("member", "path", v.alias("verdict"))
    return Outcome(catalog.join(report.where("verdict in ('row', 'bytes')").select("member", "path"), ["member", "path"], "left_anti"), report)


def header(own: DataFrame, peers: DataFrame, standalone: bool) -> DataFrame:
    """fed_id, source of the header that a rebuilt catalog takes: its own if it could be read, else the peers' if they agree on one, else none if it may stand alone. No row: refuse."""
    none = lambda df: df.where("coalesce(fed_id, '') <> ''").select("fed_id").distinct()
    agreed = none(peers).agg(F.count("*").alias("n"), F.min("fed_id").alias("fed_id")).where("n = 1").select("fed_id", F.lit(2).alias("rank"), F.lit("peers").alias("source"))
    mine = none(own).select("fed_id", F.lit(1).alias("rank"), F.lit("own").alias("source"))
    alone = own.sparkSession.range(1 if standalone else 0).select(F.lit(None).cast("string").alias("fed_id"), F.lit(3).alias("rank"), F.lit("standalone").alias("source"))
    return mine.unionByName(agreed).unionByName(alone).orderBy("rank", "fed_id").limit(1).select("fed_id", "source")


def genesis_source(receipts: DataFrame, records: DataFrame, locked: DataFrame, which: str) -> DataFrame:
    """id and the record's four fields from exactly one of the three: receipt, record or lock."""
    return {"receipt": receipts, "record": records, "lock": locked}[which].select("id", *identity.GENESIS)


def _intents(rows: DataFrame, actor: str, created_at: str) -> DataFrame:
    """rows (member, op_id, op_type, blob_refs, args) as wal.append_all takes them: in the order of op_id, with position, actor and the time's text. Positions are the ids' first 15 hex digits, so no order is counted."""
    return rows.select("member", F.conv(F.substring(F.sha2("op_id", 256), 1, 15), 16, 10).cast("long").alias("position"), "op_id", "op_type", "blob_refs", F.lit(actor).alias("actor"), F.lit(created_at).alias("created_at"), "args")


def sweep_federated(objects: DataFrame, catalog: DataFrame, plan: DataFrame, log: DataFrame, run: str, actor: str = "gc", created_at: str = "1970-01-01T00:00:00Z") -> Outcome:
    """A federated collection carried out: of the eligible keys of plan those whose id has an intent in log by now are skipped-pending; the others' ids go into gc intents, and where these are appended, objects and
    rows go. table: the catalog after; report: object_key, op_id, verdict: deleted, skipped-pending or blocked; intents: with append_all's columns.

    A sweep is one intent for each member and first two digits of the ids, so that none grows with the store; their op_ids follow from run, so a rerun of a run that failed finds its own.
    """
    git = catalog.where("sync_mode = 'git'").groupBy("sha256").agg(F.max_by(F.struct("id", "member"), "path").alias("x")).select(F.col("sha256").alias("object_key"), "x.id", "x.member")
    busy = wal.pending(log).select(F.explode("blob_refs").alias("id")).distinct().withColumn("busy", F.lit(True))
    op = identity.op_id(F.lit("gc"), F.lit(run), F.col("member"), F.substring("id", 1, 2))
    doomed = plan.where("verdict = 'eligible'").select("object_key").join(git, "object_key", "left").join(busy, "id", "left").withColumn("op_id", F.when(F.col("busy").isNull(), op))
    ops = doomed.where("op_id is not null").groupBy("member", "op_id").agg(F.sort_array(F.collect_list("id")).alias("blob_refs"))
    intents = wal.append_all(log, _intents(ops.withColumn("op_type", F.lit("gc")).withColumn("args", F.lit(None).cast("map<string,string>")), actor, created_at))
    made = intents.select("member", "op_id", F.col("verdict").alias("v"))
    v = F.when(F.col("busy"), "skipped-pending").when(F.col("v").isin("appended", "duplicate"), "deleted").otherwise("blocked")
    report = doomed.join(made, ["member", "op_id"], "left").select("object_key", "op_id", v.alias("verdict"))
    gone = report.where("verdict = 'deleted'").select(F.col("object_key").alias("sha256"))
    return Outcome(gc.forget(catalog, gone), report, intents)


def gc_retry(op: DataFrame, catalog: DataFrame) -> Outcome:
    """A gc operation finished: op has its blob_refs. report: object_key of what is still to be deleted, for ids that the catalog still has; table: the catalog without their rows. Ids that are gone are done."""
    ids = op.select(F.explode("blob_refs").alias("id")).distinct()
    still = catalog.join(ids, "id", "left_semi")
    return Outcome(catalog.join(still.select("member", "path"), ["member", "path"], "left_anti"), still.select(F.col("sha256").alias("object_key")).distinct())


def move_across(catalog: DataFrame, moves: DataFrame, objects: DataFrame, log: DataFrame, actor: str = "mv", created_at: str = "1970-01-01T00:00:00Z") -> Outcome:
    """The catalog after moves between members (member, path, to_member, to_path), journaled at both ends. objects: object_key, observed_sha as they arrived.

    report: move's refusals, then no-bytes, corrupt (git keeps the bytes, and they aren't the recorded ones), blocked (an end's log takes no intent), rehomed (the bytes of a file that git doesn't keep have changed: the row
    goes on under their hash, and their object with it) or moved. intents: the source's says where the file went, the destination's carries its whole record; ids never change.
    """
    plain = move(catalog, moves).report
    c = catalog.select("member", "path", "id", "sha256", "sync_mode", "size", *identity.GENESIS)
    j = plain.join(c, ["member", "path"], "left").join(objects.select(F.col("object_key").alias("sha256"), F.col("observed_sha").alias("arrived")), "sha256", "left")
    v = F.when(F.col("verdict") != "moved", F.col("verdict")).when(F.col("arrived").isNull(), "no-bytes").when(F.col("arrived") == F.col("sha256"), "moved").when(F.col("sync_mode") == "manual", "rehomed").otherwise("corrupt")
    j = j.withColumn("verdict", v).withColumn("op_id", identity.op_id(F.lit("mv"), F.col("id"), F.col("member"), F.col("to_member"), F.col("to_path")))
    go = j.where("verdict in ('moved', 'rehomed')")
    pair = lambda *kv: F.create_map(*[x for k, c in kv for x in (F.lit(k), F.col(c))])
    src = go.select("member", "op_id", F.lit("move").alias("op_type"), F.array("id").alias("blob_refs"), pair(("path", "path"), ("moved_to", "to_member")).alias("args"))
    dst = go.select(F.col("to_member").alias("member"), "op_id", F.lit("move").alias("op_type"), F.array("id").alias("blob_refs"), pair(("id", "id"), ("dest_path", "to_path"), ("sync_mode", "sync_mode"), ("sha256", "arrived"), *[(k, k) for k in identity.GENESIS]).alias("args"))
    intents = wal.append_all(log, _intents(src.unionByName(dst), actor, created_at))
    barred = intents.where("verdict not in ('appended', 'duplicate')").select("op_id", F.lit(True).alias("barred")).distinct()
    j = j.join(barred, "op_id", "left").withColumn("verdict", F.when(F.col("verdict").isin("moved", "rehomed") & F.col("barred"), "blocked").otherwise(F.col("verdict")))
    ok = j.where("verdict in ('moved', 'rehomed')").select("member", "path", "to_member", "to_path", "arrived")
    t = catalog.join(ok, ["member", "path"], "left").withColumn("path", F.coalesce("to_path", "path")).withColumn("member", F.coalesce("to_member", "member")).withColumn("sha256", F.coalesce("arrived", "sha256"))
    return Outcome(t.select(*catalog.columns), j.select("member", "path", "to_member", "to_path", "verdict"), intents)


def apply_scan(catalog: DataFrame, disk: DataFrame, log: DataFrame, member: str, at_s: int, actor: str = "scan", created_at: str = "1970-01-01T00:00:00Z") -> Outcome:
    """A member's catalog after a scan, journaled change by change: suspect files are skipped, verified ones only move their scan time, and of the others those whose file has an intent under way are skipped while the rest apply.

    report: path, kind, verdict: applied, skipped-suspect, skipped-in-flight or skipped-chain-broken. catalog: of the member, with the record's fields and last_scanned_s. Op_ids follow from what changed, so a second run resumes the first.
    """
    found = scan.diff(catalog, disk).withColumn("op_id", identity.op_id(F.lit("scan"), F.lit(member), F.col("kind"), F.coalesce("old_path", "path"), F.col("path"), F.col("sha256")))
    g = {"content_sha256": F.col("sha256"), "original_path": F.col("path"), "ingest_op_id": F.col("op_id"), "origin_node": F.lit(member)}
    ops = scan.to_operations(found).select("path", "op_type", "args")
    ids = catalog.select(F.col("path").alias("__at"), F.col("id").alias("__id"))
    j = found.join(ops, "path", "left").join(ids, F.coalesce("old_path", "path") == F.col("__at"), "left").withColumn("id", F.coalesce("__id", identity.mint_id(g))).drop("__at", "__id")
    intents = wal.append_all(log, _intents(j.where("op_type is not null").select(F.lit(member).alias("member"), "op_id", "op_type", F.array("id").alias("blob_refs"), "args"), actor, created_at))
    v = F.when(F.col("kind") == "suspect", "skipped-suspect").when((F.col("kind") == "verified") | F.col("v").isin("appended", "duplicate"), "applied").otherwise(F.concat(F.lit("skipped-"), F.col("v")))
    done = j.join(intents.select("op_id", F.col("verdict").alias("v")), "op_id", "left").withColumn("verdict", v)
    ok = done.where("verdict = 'applied'")
    seen = disk.select("path", F.col("size").alias("new_size"))
    change = ok.where("kind <> 'added'").select(F.coalesce("old_path", "path").alias("path"), "kind", F.col("path").alias("new_path"), F.col("sha256").alias("new_sha"))
    t = catalog.join(change, "path", "left").where("kind is null or kind <> 'deleted'")
    t = t.withColumn("path", F.coalesce("new_path", "path")).withColumn("sha256", F.coalesce("new_sha", "sha256")).withColumn("last_scanned_s", F.when(F.col("kind").isNotNull(), F.lit(at_s).cast("long")).otherwise(F.col("last_scanned_s")))
    t = t.join(seen, "path", "left").withColumn("size", F.when(F.col("kind").isNotNull(), F.coalesce("new_size", "size")).otherwise(F.col("size"))).select(*catalog.columns)
    new = ok.where("kind = 'added'").join(seen, "path", "left")
    made = {"member": F.lit(member), "path": F.col("path"), "id": F.col("id"), "sha256": F.col("sha256"), "size": F.col("new_size"), "sync_mode": F.lit("manual"), "last_scanned_s": F.lit(at_s).cast("long"), **g}
    return Outcome(t.unionByName(new.select(*[made.get(c, F.lit(None).cast(catalog.schema[c].dataType)).alias(c) for c in catalog.columns])), done.select("path", "kind", "verdict"), intents)


def bootstrap(listing: DataFrame, member: str, log: DataFrame) -> DataFrame:
    """path, op_id, id, action of the ingest of a listing (path, sha256, size): done where the log has the operation as done, resume where it has it otherwise (its row and its marker are written again), new where not at all."""
    op = identity.op_id(F.lit("ingest"), F.lit(member), F.col("path"), F.col("sha256"))
    g = {"content_sha256": F.col("sha256"), "original_path": F.col("path"), "ingest_op_id": F.col("op_id"), "origin_node": F.lit(member)}
    known = log.groupBy("op_id").agg(F.bool_or(F.col("state") == "done").alias("finished"))
    j = listing.withColumn("op_id", op).join(known, "op_id", "left")
    return j.select("path", "op_id", identity.mint_id(g).alias("id"), F.when(F.col("finished"), "done").when(F.col("finished").isNotNull(), "resume").otherwise("new").alias("action"))


def init_vault(walked: DataFrame, hashes: DataFrame, member: str, log: DataFrame) -> DataFrame:
    """bootstrap for what a walk kept (path, kept): its files with their hashes (path, sha256, size)."""
    return bootstrap(hashes.join(walked.where("kept").select("path"), "path", "left_semi"), member, log)


def federation_id(founder: Column, node: Column, actor: Column, created_at: Column) -> Column:
    """A new federation's id: the hash of the entry that founds it, at seq 0 of an empty log. created_at: the time's text."""
    args = F.create_map(F.lit("action"), F.lit("init"), F.lit("member"), founder, F.lit("node"), node)
    return F.sha2(identity.wal_text({"seq": F.lit(0), "op_id": roster_op_id(F.lit(""), F.lit("init"), founder), "prev_hash": F.lit(wal.ZERO), "op_type": F.lit("roster"), "blob_refs": F.array().cast("array<string>"), "actor": actor, "created_at": created_at, "args": args}), 256)


def roster_op_id(fed_id: Column, action: Column, target: Column) -> Column:
    """The same for every write of one change, so that a second one is a duplicate."""
    return identity.op_id(F.lit("fed-roster"), fed_id, action, target)


def write_roster(rosters: DataFrame, observers: DataFrame, roster: DataFrame, catalogs: DataFrame, log: DataFrame, fed_id: str, action: str, target: str, actor: str = "fed", created_at: str = "1970-01-01T00:00:00Z") -> Outcome:
    """The rosters (observer, fed_id, name, node, joined_at_s, status) after roster replaces the copies of observers (observer), each journaled in its own log. catalogs: member of those that have one.

    report: observer, verdict: written, no-catalog, or what barred the intent: in-flight, chain-broken. A change that a log already has is written again, to the same rows.
    """
    op = roster_op_id(F.lit(fed_id), F.lit(action), F.lit(target))
    o = observers.join(catalogs.select(F.col("member").alias("observer"), F.lit(True).alias("has")).distinct(), "observer", "left")
    args = F.create_map(F.lit("action"), F.lit(action), F.lit("member"), F.lit(target), F.lit("fed_id"), F.lit(fed_id))
    intents = wal.append_all(log, o.where("has").select(F.col("observer").alias("member"), F.lit(0).cast("long").alias("position"), op.alias("op_id"), F.lit("roster").alias("op_type"), F.array().cast("array<string>").alias("blob_refs"), F.lit(actor).alias("actor"), F.lit(created_at).alias("created_at"), args.alias("args")))
    j = o.join(intents.select(F.col("member").alias("observer"), F.col("verdict").alias("v")), "observer", "left")
    report = j.select("observer", F.when(F.col("has").isNull(), "no-catalog").when(F.col("v").isin("appended", "duplicate"), "written").otherwise(F.col("v")).alias("verdict"))
    now = report.where("verdict = 'written'").select("observer")
    copies = now.join(roster.select("name", "node", "joined_at_s", "status"), F.lit(True)).withColumn("fed_id", F.lit(fed_id))  # members times members
    return Outcome(rosters.join(now, "observer", "left_anti").unionByName(copies.select(*rosters.columns)), report, intents)


def join_federation(members: DataFrame, name: str, node: str, at_s: int) -> DataFrame:
    """The roster (name, node, joined_at_s, status) with a member: one that is active stays as it is, so joining twice changes nothing; one that left or was evicted is active again from at_s."""
    new = members.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(node).alias("node"), F.lit(at_s).cast("long").alias("joined_at_s"), F.lit("active").alias("status"))
    stays = members.where((F.col("name") == name) & (F.col("status") == "active"))
    return members.where((F.col("name") != name) | (F.col("status") == "active")).unionByName(new.join(stays.select("name"), "name", "left_anti").select(*members.columns))


def verify(lock: DataFrame, versions: DataFrame, objects: DataFrame, findings: DataFrame) -> DataFrame:
    """n_corrupt, n_missing, n_findings, exit_code of a whole verification: 5 for corrupt or missing objects, and the findings' own code; the worse counts."""
    bad = locks.corrupt(objects).agg(F.count("*").alias("n_corrupt"))
    gone = locks.missing(lock, versions, objects).agg(F.count("*").alias("n_missing"))
    three = findings.agg(F.count("*").alias("n_findings"))
    j = bad.join(gone, F.lit(True)).join(three, F.lit(True)).join(scan.worst(findings).withColumnRenamed("exit_code", "code"), F.lit(True))  # a row each
    return j.select("n_corrupt", "n_missing", "n_findings", F.greatest(F.when((F.col("n_corrupt") > 0) | (F.col("n_missing") > 0), 5).otherwise(0), F.col("code")).alias("exit_code"))


def pull(tree: DataFrame, lock: DataFrame, resolved: DataFrame, members: DataFrame, objects: DataFrame) -> DataFrame:
    """path, verdict, member, warning, exit_code for each live entry of a lock (path, id, sha256, location): current where the tree has it, else as resolve_entries says where from, and there no-bytes, corrupt or fetched."""
    live = lock.where("not deleted")
    have = tree.select("path", "sha256", F.lit(True).alias("have"))
    from_ = federation.resolve_entries(live, resolved, members)
    j = live.select("path", "sha256").join(have, ["path", "sha256"], "left").join(from_, "path").join(objects.select(F.col("object_key").alias("sha256"), "observed_sha"), "sha256", "left")
    v = F.when(F.col("have"), "current").when(F.col("member").isNull(), "unresolved").when(F.col("observed_sha").isNull(), "no-bytes").when(F.col("observed_sha") != F.col("sha256"), "corrupt").otherwise("fetched")
    code = F.when(v.isin("current", "fetched"), 0).when((v == "unresolved") & (F.col("warning") != "unresolved-missing"), 6).otherwise(5)
    return j.select("path", v.alias("verdict"), F.when(~F.coalesce("have", F.lit(False)), F.col("member")).alias("member"), F.when(~F.coalesce("have", F.lit(False)), F.col("warning")).alias("warning"), code.alias("exit_code"))


def stat(catalog: DataFrame, resolved: DataFrame, objects: DataFrame) -> DataFrame:
    """id, member, path, sync_mode, size, outcome, freshness of resolved files: fresh, drifted or unknown by the bytes at the member that has them."""
    j = resolved.select("id", "outcome", "member").join(catalog.select("id", "member", "path", "sync_mode", "size", "sha256"), ["id", "member"], "left").join(objects.select(F.col("object_key").alias("sha256"), "observed_sha"), "sha256", "left")
    fresh = F.when(F.col("observed_sha").isNull(), "unknown").when(F.col("observed_sha") == F.col("sha256"), "fresh").otherwise("drifted")
    return j.select("id", "member", "path", "sync_mode", "size", "outcome", fresh.alias("freshness"))


def repo_track(include: list[str], wanted: list[str], tree: DataFrame) -> tuple[list[str], DataFrame]:
    """The include list with the globs wanted that it lacks, and path of the files that these match. All globs are read before any is added: a bad one changes nothing."""
    for g in wanted:
        globs.to_regex(g)
    return [*include, *dict.fromkeys(g for g in wanted if g not in include)], tree.where(globs.any_match(wanted, F.col("path"))).select("path")
