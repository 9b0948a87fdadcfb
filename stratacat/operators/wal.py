"""The operation log: state, chain, pruning, waiting, appending."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.functions.identity import wal_parts

ZERO = "0" * 64


def effective_state(entries: DataFrame, markers: DataFrame) -> DataFrame:
    """entries with state: done if any marker says so, else failed if any does, else intent. markers: member, seq, mark."""
    m = markers.groupBy("member", "seq").agg(F.max(F.when(F.col("mark") == "done", 2).when(F.col("mark") == "failed", 1).otherwise(0)).alias("m"))
    return entries.join(m, ["member", "seq"], "left").withColumn("state", F.when(F.col("m") == 2, "done").when(F.col("m") == 1, "failed").otherwise("intent")).drop("m")


def pending(wal: DataFrame, ref: Column | None = None) -> DataFrame:
    rows = wal.where("state = 'intent'")
    return rows if ref is None else rows.where(F.array_contains("blob_refs", ref))


def anchors(prunes: DataFrame) -> DataFrame:
    """member, seq, hash: the anchor with the highest seq."""
    return prunes.groupBy("member").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def chain_breaks(wal: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """member, seq, problem: gap where seq doesn't follow, link where prev_hash isn't the hash of the entry before. The first entry follows the anchor, or is 0 and links to zeros.

    Each entry meets the one before by (member, seq): a join on both, so that one member's long log spreads over all tasks.
    """
    if anchor is not None:
        wal = wal.join(anchor.select("member", F.col("seq").alias("a_seq"), F.col("hash").alias("a_hash")), "member", "left").where(F.col("a_seq").isNull() | (F.col("seq") > F.col("a_seq")))
    else:
        wal = wal.withColumn("a_seq", F.lit(None).cast("long")).withColumn("a_hash", F.lit(None).cast("string"))
    before = wal.select("member", (F.col("seq") + 1).alias("seq"), F.col("self_hash").alias("before"), F.lit(True).alias("follows"))
    j = wal.join(before, ["member", "seq"], "left")
    first = F.col("seq") == F.coalesce(F.col("a_seq"), F.lit(-1)) + 1
    bad = F.when(F.col("follows").isNull() & ~first, "gap").when(~F.col("prev_hash").eqNullSafe(F.when(F.col("follows"), F.col("before")).otherwise(F.coalesce("a_hash", F.lit(ZERO)))), "link")
    return j.withColumn("problem", bad).where("problem is not null").select("member", "seq", "problem")


def verified(wal: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """The entries after each member's anchor, of the members whose chain holds; those of the others aren't given. chain_breaks says which those are."""
    rows = wal if anchor is None else wal.join(anchor.select("member", F.col("seq").alias("a_seq")), "member", "left").where("a_seq is null or seq > a_seq").drop("a_seq")
    return rows.join(chain_breaks(wal, anchor).select("member").distinct(), "member", "left_anti")


def prunable(wal: DataFrame, before: Column) -> DataFrame:
    """member, seq of the leading entries that are done and older than before; the first other entry ends them. One combining minimum a member."""
    keep = ~((F.col("state") == "done") & (F.col("created_at") < before))
    first = wal.groupBy("member").agg(F.min(F.when(F.coalesce(keep, F.lit(True)), F.col("seq"))).alias("first"))
    return wal.join(first, "member").where("first is null or seq < first").select("member", "seq")


def next_slot(wal: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """member, seq, prev_hash of the entry that would be appended next: after the last entry, or of a log that is all pruned after its anchor."""
    rows = wal.select("member", "seq", F.col("self_hash").alias("hash"))
    rows = rows if anchor is None else rows.unionByName(anchor.select("member", "seq", "hash"))
    return rows.groupBy("member").agg((F.max("seq") + 1).alias("seq"), F.max_by("hash", "seq").alias("prev_hash"))


def waits_on(wal: DataFrame, key: str = "path") -> DataFrame:
    """member, op_id, n_waits of operations that aren't done: the earlier ones of the member that aren't and touch the same key.

    Equal keys meet in one window; earlier rows are counted in order, so no pairs are made.
    """
    w = Window.partitionBy("member", key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return wal.where("state <> 'done'").select("member", "op_id", F.count("*").over(w).alias("n_waits"))


def waits_on_refs(wal: DataFrame) -> DataFrame:
    """member, op_id, waits, head of operations that aren't done: whether an earlier one of the member that isn't shares any of blob_refs with it, and the first such one's id.

    An operation waits if the first one open on any of its refs came before it: one combining minimum a ref, no pairs.
    """
    open_ = wal.where("state <> 'done'")
    refs = open_.select("member", "seq", "op_id", F.explode(F.array_distinct("blob_refs")).alias("ref"))
    first = refs.groupBy("member", "ref").agg(F.min(F.struct("seq", "op_id")).alias("first"))
    before = refs.join(first, ["member", "ref"]).where("first.seq < seq").groupBy("member", "op_id").agg(F.min("first").alias("first"))
    return open_.select("member", "op_id").join(before, ["member", "op_id"], "left").select("member", "op_id", F.col("first").isNotNull().alias("waits"), F.col("first.op_id").alias("head"))


def waits_on_ops(wal: DataFrame, wide: int = 32) -> DataFrame:
    """member, op_id, waits_on: each earlier open operation of the member that shares any of blob_refs, once, as a row. The rows are the answer's own: use waits_on_refs to ask only whether and on which first.

    Of the refs by which a pair waits only the least gives its row, so no pair is shuffled or stored to find repeats: each row knows the lesser refs of its operation that others have too. Operations with more
    than `wide` refs don't carry them; their pairs alone are made distinct.
    """
    key = ["member", "op_id", "ref"]
    refs = wal.where("state <> 'done'").select("member", "seq", "op_id", F.explode(F.array_distinct("blob_refs")).alias("ref")).where("member is not null and ref is not null and seq is not null")
    each = refs.groupBy(*key).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    ops = each.groupBy("member", "op_id").agg(F.array_sort(F.collect_list(F.struct("ref", "first", "last"))).alias("refs"))
    less = F.when(F.size("refs") <= wide, F.slice("refs", F.lit(1), F.col("i")))
    rows = ops.select("member", "op_id", "refs", F.posexplode("refs").alias("i", "r")).select("member", "op_id", F.col("r.ref").alias("ref"), F.col("r.first").alias("first"), F.col("r.last").alias("last"), less.alias("less"))
    pre = rows.select("member", "ref", F.col("op_id").alias("waits_on"), F.col("first").alias("pre"), F.col("less").alias("pre_less"))
    met = lambda x, y: x.join(y, ["member", "ref"]).where("pre < last")
    sooner = F.exists("less", lambda x: F.exists("pre_less", lambda y: (x["ref"] == y["ref"]) & (y["first"] < x["last"])))
    few, columns = rows.where("less is not null"), ["member", "op_id", "waits_on"]
    once = met(few, pre.where("pre_less is not null")).where(~sooner).select(*columns)
    many = met(rows.where("less is null"), pre).select(*columns).union(met(few, pre.where("pre_less is null")).select(*columns))
    return once.unionByName(many.distinct())


def overlaps(a: Column, b: Column) -> Column:
    """Whether two arrays of refs share one; false where either is null."""
    return F.coalesce(F.arrays_overlap(F.filter(a, lambda x: x.isNotNull()), F.filter(b, lambda x: x.isNotNull())), F.lit(False))


def of_member(rows: DataFrame, member: str = "") -> DataFrame:
    """rows of a member; of all members where none is named."""
    return rows.where(F.col("member") == member) if member else rows


def sweep(wal: DataFrame, breaks: DataFrame, key: str = "path") -> DataFrame:
    """waits_on with op_type and state for the members whose chain holds; the others' operations are withheld."""
    rows = wal.join(breaks.select("member").distinct(), "member", "left_anti")
    return rows.where("state <> 'done'").select("member", "op_id", "op_type", "state").join(waits_on(rows, key), ["member", "op_id"])


def retryable(swept: DataFrame, backends: dict[str, str]) -> DataFrame:
    """member, op_id, verdict: waits, gc, replay, or refused. Replay takes ingest, scan, move and delete, and only where the member's store is mounted."""
    backend = F.lit(None).cast("string")
    for m, b in backends.items():
        backend = F.when(F.col("member") == m, b).otherwise(backend)
    v = F.when(F.col("n_waits") > 0, "waits").when(F.col("op_type") == "gc", "gc").when(F.col("op_type").isin("ingest", "scan", "move", "delete") & backend.isin("local", "share"), "replay").otherwise("refused")
    return swept.select("member", "op_id", v.alias("verdict"))


def ops_listing(swept: DataFrame, member: str = "") -> DataFrame:
    """member, op_id, op_type, state, n_waits of the swept operations of a member, or of all."""
    return of_member(swept, member).select("member", "op_id", "op_type", "state", "n_waits")


def pending_exit(swept: DataFrame, fail_pending: bool) -> DataFrame:
    """exit_code: 1 if any operation is pending and that is to fail, else 0."""
    return swept.agg(F.when(F.lit(fail_pending) & (F.count("*") > 0), 1).otherwise(0).alias("exit_code"))


def retry_pass(verdicts: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """member, op_id, result of one pass over retryable's verdicts: waits and refused stay refused, also where what they wait on is retried in the same pass; gc and replay are done unless outcomes (member, op_id, ok) says failed."""
    tried = F.col("verdict").isin("gc", "replay")
    j = verdicts if outcomes is None else verdicts.join(outcomes.select("member", "op_id", "ok"), ["member", "op_id"], "left")
    ok = F.lit(True) if outcomes is None else F.coalesce("ok", F.lit(True))
    return j.select("member", "op_id", F.when(~tried, "refused").when(ok, "done").otherwise("failed").alias("result"))


def needing_attention(breaks: DataFrame) -> DataFrame:
    """member, first_seq: members whose chain is broken, and where first."""
    return breaks.groupBy("member").agg(F.min("seq").alias("first_seq"))


def committed(wal: DataFrame) -> DataFrame:
    """member, committed: whether any operation of a member's log is done."""
    return wal.groupBy("member").agg(F.coalesce(F.bool_or(F.col("state") == "done"), F.lit(False)).alias("committed"))


#: What an append that wasn't made ends with: a duplicate resumes, an operation in flight is a precondition, a broken chain is the federation's.
APPEND_EXIT = {"appended": 0, "duplicate": 0, "in-flight": 2, "chain-broken": 6}


def append_exit(verdict: Column) -> Column:
    code = F.lit(4)
    for k, v in APPEND_EXIT.items():
        code = F.when(verdict == k, v).otherwise(code)
    return code


APPENDED = "member string, seq long, op_id string, prev_hash string, op_type string, blob_refs array<string>, actor string, created_at string, args map<string,string>, self_hash string, state string"


def append_all(wal: DataFrame, candidates: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """The candidates with APPENDED's columns, position and verdict, as if they came one after the other: chain-broken for all of a member whose log doesn't verify, duplicate for an op_id that the
    log has or the batch has appended, in-flight for one that shares a ref with an intent of the log or one appended before, else appended. Only appended ones have a seq and hashes; a candidate that is refused bars nobody.

    candidates: member, position, op_id, op_type, blob_refs, actor, created_at (its text), args. wal: member, seq, op_id, prev_hash, self_hash, blob_refs, state. Each entry's hash needs
    the one before, so a member's batch is read in order, streamed; a task keeps the refs that the batch has taken. Batches are what one writer appends at once, not the log.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = f"{APPENDED}, position long, verdict string"
    schema = to_arrow_schema(_parse_datatype_string(out))
    names = [f.split()[0] for f in APPENDED.split(", ")]
    busy = pending(wal).select("member", F.explode("blob_refs").alias("ref")).distinct()
    barred = candidates.select("member", "position", F.explode("blob_refs").alias("ref")).join(busy, ["member", "ref"], "left_semi").select("member", "position", F.lit(True).alias("barred")).distinct()
    known = wal.select("member", "op_id", F.lit(True).alias("known")).distinct()
    broken = chain_breaks(wal, anchor).select("member", F.lit(True).alias("broken")).distinct()
    slots = next_slot(wal, anchor).select("member", F.col("seq").alias("base"), F.col("prev_hash").alias("tail"))
    c = candidates.join(barred, ["member", "position"], "left").join(known, ["member", "op_id"], "left").join(broken, "member", "left").join(slots, "member", "left")
    front, back = wal_parts({k: F.lit(0) if k == "seq" else F.col(k) for k in ("seq", "op_id", "op_type", "blob_refs", "actor", "created_at", "args")})
    c = c.select("member", "position", "op_id", "op_type", "blob_refs", "actor", "created_at", "args", *[F.coalesce(k, F.lit(False)).alias(k) for k in ("barred", "known", "broken")], F.coalesce("base", F.lit(0).cast("long")).alias("base"), F.coalesce("tail", F.lit(ZERO)).alias("tail"), F.substring_index(front, "\n", -2).alias("front"), back.alias("back"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, seq, prev, ops, refs = None, 0, ZERO, set(), set()
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["member"] != member:
                    member, seq, prev, ops, refs = r["member"], r["base"], r["tail"], set(), set()
                verdict = "chain-broken" if r["broken"] else "duplicate" if r["known"] or r["op_id"] in ops else "in-flight" if r["barred"] or not refs.isdisjoint(r["blob_refs"] or ()) else "appended"
                row = {k: r.get(k) for k in names} | {"position": r["position"], "verdict": verdict}
                if verdict == "appended":
                    self_hash = hashlib.sha256(f'seq = {seq}\n{r["front"]}prev_hash = "{prev}"\n{r["back"]}'.encode()).hexdigest()
                    row |= {"seq": seq, "prev_hash": prev, "self_hash": self_hash, "state": "intent"}
                    seq, prev = seq + 1, self_hash
                    ops.add(r["op_id"])
                    refs.update(r["blob_refs"] or ())
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return c.repartition("member").sortWithinPartitions("member", "position").mapInArrow(run, out)


def append(wal: DataFrame, candidates: DataFrame, anchor: DataFrame | None = None) -> DataFrame:
    """The intents that candidates add to the log, with APPENDED's columns: see append_all."""
    return append_all(wal, candidates, anchor).where("verdict = 'appended'").select(*[f.split()[0] for f in APPENDED.split(", ")])
