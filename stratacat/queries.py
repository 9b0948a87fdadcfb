"""The queries of the library over the fixture views, with DuckDB SQL that computes the same rows on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacat import schemas
from stratacat.fixtures import VIEWS, Views, duck
from stratacat.functions import globs, identity, scalars
from stratacat.operators import federation, gc, locks, lookup, projection, scan, status, wal
from stratacat.plans import pipelines
from stratacat.sources import files, sinks

MAGIC = "blob.v1"
RULES = {"min_size": 4096, "include": ["**/*.pdf", "**/*.stl"], "exclude": ["**/*.tmp", "src3/**"], "history": False, "overrides": [("src1/**", True, True), ("*/fr/**", True, None), ("**/*1.pdf", False, True)]}
IGNORE = "*.tmp\nsrc4/\nsrc5/**\n\n# kept\n!src5/en/*.md\n!src4/de/*.pdf\n"
# The same globs as regular expressions, written by hand.
RX_IN, RX_EX, RX_OV = r"^(.*/)?[^/]*\.(pdf|stl)$", r"^((.*/)?[^/]*\.tmp|src3/.*)$", (r"^src1/.*$", r"^[^/]*/fr/.*$", r"^(.*/)?[^/]*1\.pdf$")
SIZES = ["5MB", "512KB", "1048576", "5MiB", "1GiB", "1.5MB", "100B", "5 MB", "  5mb  ", "", "abc", "MB", "-5MB", "-5"]
SIZE_BYTES = [5242880, 524288, 1048576, 5242880, 1073741824, 1572864, 100, 5242880, 5242880, None, None, None, None, -5]


def _certified() -> Column:
    return identity.certifies({k: F.col(k) for k in identity.GENESIS}, F.col("id"))


def _lock_v(v: Views, lock: str) -> DataFrame:
    """fx_lock or fx_lock_theirs with versions: for history rows their content and one that both sides share."""
    d = getattr(v, lock)
    return d.withColumn("versions", F.when(F.col("history"), F.array("sha256", F.sha2(F.concat("path", F.lit("#v1")), 256))))


def _long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _lock_ids(v: Views) -> DataFrame:
    """fx_lock with the catalog's ids, of which every 19th differs and every 4th is empty."""
    c = v.fx_catalog.select("path", F.col("id").alias("cid"))
    ident = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 19 == 0, F.sha2("cid", 256)).otherwise(F.col("cid"))
    return v.fx_lock.join(c, "path", "left").withColumn("id", ident)


LOCK_IDS = "lid as (select l.*, case when l.doc_id % 4 = 0 then '' when l.doc_id % 19 = 0 then sha(c.id) else c.id end as id from @fx_lock l left join @fx_catalog c on l.path = c.path)"
GIT = "git as (select sha256, max_by(id, path) as id from @fx_catalog where sync_mode = 'git' group by sha256)"
KEEP = "keep as (select sha256 from @fx_lock union select sha256 from @fx_lock_version), pres as (select sha256 from @fx_lock where preserve union select v.sha256 from @fx_lock_version v join @fx_lock l on v.path = l.path where l.preserve)"
DRIFT = "case when d.size <> c.size or d.mtime_s > c.last_scanned_s then 'edited' else 'suspect' end"
DIFF = f"""raw as (select coalesce(c.path, d.path) as path, coalesce(d.sha256, c.sha256) as sha256,
  case when c.path is null then 'added' when d.path is null then 'deleted' when not (d.size <> c.size or d.mtime_s > c.last_scanned_s) then null when d.sha256 = c.sha256 then 'verified' else {DRIFT} end as kind
  from @fx_catalog c full join @fx_disk d on c.path = d.path where c.path is null or c.sync_mode <> 'git'),
 solo as (select sha256 from raw where kind in ('added','deleted') group by sha256 having sum(case when kind = 'added' then 1 else 0 end) = 1 and sum(case when kind = 'deleted' then 1 else 0 end) = 1),
 moved as (select a.path, 'moved' as kind, a.sha256, d.path as old_path from raw a join raw d on a.sha256 = d.sha256 and a.kind = 'added' and d.kind = 'deleted' where a.sha256 in (select sha256 from solo)),
 changes as (select * from moved union all select path, kind, sha256, null from raw where kind is not null and not (kind in ('added','deleted') and sha256 in (select sha256 from solo)))"""
THREE = f"""{LOCK_IDS}, c as (select c.*, sha(concat('content_sha256 = "',content_sha256,'"',chr(10),'original_path = "',original_path,'"',chr(10),'ingest_op_id = "',ingest_op_id,'"',chr(10),'origin_node = "',origin_node,'"',chr(10))) = id as ok, id in (select id from @fx_pending) as busy from @fx_catalog c),
 three as (select path, case when busy then 'pending-op' else 'genesis-invalid' end as kind from c where busy or not ok
  union all select c.path, 'catalog-only' from c where ok and not busy and sync_mode <> 'git' and path not in (select path from lid)
  union all select c.path, 'field-mismatch' from c join lid l on c.path = l.path where ok and not busy and l.sha256 <> c.sha256
  union all select c.path, 'field-mismatch' from c join lid l on c.path = l.path where ok and not busy and coalesce(l.id, '') <> '' and l.id <> c.id
  union all select c.path, case when d.path is null then 'missing-on-disk' when {DRIFT} = 'edited' then 'edited-since-scan' else 'corrupt' end from c left join @fx_disk d on c.path = d.path where ok and not busy and sync_mode <> 'git' and (d.path is null or d.sha256 <> c.sha256)
  union all select path, 'lock-only' from lid where path not in (select path from c))"""
MERGED = "merged as (select name, joined_at_s, status from (select *, row_number() over (partition by name order by joined_at_s desc, case status when 'evicted' then 2 when 'left' then 1 else 0 end desc, status) as rn from @fx_roster) x where rn = 1)"
RENAMES = """new as (select t.path, t.sha256, row_number() over (partition by t.sha256 order by t.path) as r from @fx_tree_r t where t.path not in (select path from @fx_lock)),
 old as (select path, sha256, row_number() over (partition by sha256 order by path) as r from @fx_lock where not deleted and path not in (select path from @fx_tree_r)),
 ren as (select old.path as old_path, new.path as new_path, old.sha256 from old join new on old.sha256 = new.sha256 and old.r = new.r)"""
# a tree in which every 8th file has been renamed, and the copies of texts make several of one content
TREE_R = "tr as (select case when doc_id % 8 = 3 then concat('moved/', path) else path end as path, sha256, size from @fx_tree)"
RENAMES = RENAMES.replace("@fx_tree_r", "tr")
WAITS = "waits as (select a.member, a.op_id, count(b.op_id) as n_waits from @fx_wal a left join @fx_wal b on a.member = b.member and a.path = b.path and b.seq < a.seq and b.state <> 'done' where a.state <> 'done' group by a.member, a.op_id)"
BREAKS = """brk as (select member, seq, case when seq <> was + 1 then 'gap' when prev_hash <> before then 'link' end as problem from
  (select *, coalesce(lag(seq) over (partition by member order by seq), -1) as was, coalesce(lag(self_hash) over (partition by member order by seq), repeat('0', 64)) as before from @fx_chain) x)"""
FORWARD = "fwd as (select member, id, max_by(moved_to, seq) filter (state = 'done') as moved_to, bool_or(state = 'intent') as pending from @fx_moves group by member, id)"
RESOLVE = f"""{FORWARD}, up as (select * from @fx_members where answered),
 views as (select coalesce(h.id, f.id) as id, coalesce(h.member, f.member) as member, h.id is not null as holds, f.moved_to, coalesce(f.pending, false) as pending, up.status = 'active' as active
   from @fx_held h full join fwd f on h.id = f.id and h.member = f.member join up on up.name = coalesce(h.member, f.member)),
 direct as (select q.id, coalesce(max(case when v.member = q.home then v.member end), min(v.member)) as who from @fx_query q join views v on v.id = q.id and v.active and v.holds group by q.id),
 hop(id, start, seen, dest, n, ending) as (select v.id, v.member, [v.member], v.moved_to, 0, cast(null as varchar) from views v where v.active and not v.holds and v.moved_to is not null and v.id not in (select id from direct)
   union all select h.id, h.start, list_append(h.seen, h.dest), case when x.e = 'next' then v.moved_to else h.dest end, h.n + 1, case when x.e = 'next' then (case when h.n = 3 then 'error' end) else x.e end
   from hop h left join @fx_members m on m.name = h.dest left join views v on v.id = h.id and v.member = h.dest,
   lateral (select case when list_contains(h.seen, h.dest) then 'error' when not coalesce(m.answered, false) then 'partial' when v.holds then 'found' when v.moved_to is null then 'dead' else 'next' end as e) x where h.ending is null and h.n < 4),
 chain as (select id, min_by(ending, start) as ending, min_by(dest, start) as dest from hop where ending in ('found', 'partial', 'error') group by id),
 res as (select q.id, q.home, case when d.who = q.home then 'found-at-home' when d.who is not null then 'found-elsewhere' when c.ending = 'found' then (case when c.dest = q.home then 'found-at-home' else 'found-elsewhere' end) when c.ending = 'partial' then 'partial-view' when c.ending = 'error' then 'error'
   when exists (select 1 from @fx_members where status = 'active' and not answered) or exists (select 1 from views v where v.id = q.id and v.active and not v.holds and v.pending) then 'partial-view' else 'missing' end as outcome,
   coalesce(d.who, case when c.ending = 'found' then c.dest end) as member, case when d.who is null and c.ending = 'partial' then c.dest end as pointer from (select distinct id, home from @fx_query) q left join direct d on d.id = q.id left join chain c on c.id = q.id)"""
SEMVERS = "(select concat(case when p_partkey % 3 = 0 then 'v' else '' end, cast(p_partkey % 4 as string), '.', cast(p_size as string), '.', cast(p_partkey % 7 as string), case when p_partkey % 5 = 0 then '-rc1' when p_partkey % 11 = 0 then 'x' else '' end) as a, concat('1.', cast(p_partkey % 60 as string), '.3') as b, p_partkey from @part)"


def _tree_r(v: Views) -> DataFrame:
    return v.fx_tree.select(F.when(F.col("doc_id") % 8 == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), "sha256", "size")


def _moves_state(v: Views) -> DataFrame:
    return federation.resolve(v.fx_query, v.fx_held, v.fx_moves, v.fx_members)


def _wal_args(v: Views) -> DataFrame:
    """fx_wal with arguments: moves within a user's paths, sync modes, sizes."""
    other = F.concat(F.substring_index("path", "/", 1), F.lit("/k"), (F.col("event_id") % 4).cast("string"))
    size = (F.col("event_id") % 1000).cast("string")
    a = F.create_map
    p = lambda k, c: (F.lit(k), c)
    args = (
        F.when(F.col("op_type") == "ingest", a(*p("path", F.col("path")), *p("content_sha256", F.col("content_sha256")), *p("size", size)))
        .when(F.col("op_type") == "scan", a(*p("path", F.col("path")), *p("new_sha256", F.col("content_sha256"))))
        .when(F.col("op_type") == "move", a(*p("from", F.col("path")), *p("to", other)))
        .when(F.col("op_type") == "sync_mode", a(*p("path", F.col("path")), *p("to_mode", F.lit("git"))))
        .otherwise(a(*p("path", F.col("path"))))
    )
    return v.fx_wal.withColumn("args", args).withColumn("blob_refs", F.array("op_id"))


def _log(v: Views, view: str = "fx_log") -> DataFrame:
    return getattr(v, view).withColumn("blob_refs", F.array("path", "ref2"))


def _candidates(v: Views) -> DataFrame:
    return v.fx_candidate.select("member", "position", "op_id", F.lit("ingest").alias("op_type"), F.array("ref1", "ref2").alias("blob_refs"), F.lit("me").alias("actor"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.create_map(F.lit("path"), F.col("ref1")).alias("args"))


def _appended(v: Views) -> DataFrame:
    made = wal.append_all(_log(v), _candidates(v))
    return made.select("member", "position", "verdict", wal.append_exit(F.col("verdict")).cast("long").alias("exit_code"), "seq", "prev_hash", "self_hash")


#: One candidate after the other: what the batch has taken travels with each member's row.
APPEND = """with recursive busy as (select distinct member, path as ref from @fx_log where state = 'intent' union select member, ref2 from @fx_log where state = 'intent'),
 cand as (select c.*, exists (select 1 from @fx_log l where l.member = c.member and l.op_id = c.op_id) as known, exists (select 1 from busy b where b.member = c.member and b.ref in (c.ref1, c.ref2)) as barred, row_number() over (partition by c.member order by position) as i from @fx_candidate c),
 st(member, i, seq, prev, ops, refs, position, verdict, placed, was, self_hash) as (
  select member, 0::bigint, (max(seq) + 1)::bigint, max_by(self_hash, seq), []::varchar[], []::varchar[], null::bigint, null::varchar, null::bigint, null::varchar, null::varchar from @fx_log group by member
  union all select y.member, y.i, case when y.v = 'appended' then y.seq + 1 else y.seq end, case when y.v = 'appended' then y.h else y.prev end, case when y.v = 'appended' then list_append(y.ops, y.op_id) else y.ops end,
   case when y.v = 'appended' then list_concat(y.refs, [y.ref1, y.ref2]) else y.refs end, y.position::bigint, y.v, case when y.v = 'appended' then y.seq end, case when y.v = 'appended' then y.prev end, case when y.v = 'appended' then y.h end
  from (select x.*, sha('seq = ' || seq || chr(10) || 'op_id = "' || op_id || '"' || chr(10) || 'prev_hash = "' || prev || '"' || chr(10) || 'op_type = "ingest"' || chr(10) || 'blob_refs = ["' || ref1 || '", "' || ref2 || '"]' || chr(10) || 'actor = "me"' || chr(10) || 'created_at = 2024-01-01T00:00:00Z' || chr(10) || chr(10) || '[args]' || chr(10) || 'path = "' || ref1 || '"' || chr(10)) as h
   from (select c.member, c.i, c.position, c.op_id, c.ref1, c.ref2, st.seq, st.prev, st.ops, st.refs, case when c.known or list_contains(st.ops, c.op_id) then 'duplicate' when c.barred or list_contains(st.refs, c.ref1) or list_contains(st.refs, c.ref2) then 'in-flight' else 'appended' end as v from st join cand c on c.member = st.member and c.i = st.i + 1) x) y)
 select member, position, verdict, (case verdict when 'in-flight' then 2 else 0 end)::bigint as exit_code, placed as seq, was as prev_hash, self_hash from st where i > 0"""


def _by_member():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("member").orderBy("doc_id")


GENESIS_SHA = """sha(concat('content_sha256 = "',content_sha256,'"',chr(10),'original_path = "',original_path,'"',chr(10),'ingest_op_id = "',ingest_op_id,'"',chr(10),'origin_node = "',origin_node,'"',chr(10)))"""
LOCATION = [f"case when s_suppkey % {n} = {r} then '' else {v} end as {c}" for c, n, r, v in (("node", 3, 0, "'n'"), ("base_path", 11, 3, "'/b'"), ("user", 4, 1, "'u'"), ("share", 5, 2, "'s'"))] + ["case s_suppkey % 4 when 0 then 'local' when 1 then 'ssh' when 2 then 'share' else 'odd' end as backend"]
PEER = """concat('{"Peer": {"k": {"HostName": "', case when n_nationkey % 4 = 0 then '' else n_name end, '", "DNSName": "', n_name, '.net.", "Online": ', case when n_nationkey % 3 > 0 then 'true' else 'false' end, ', "IPs": [', case when n_nationkey % 8 = 0 then '' else concat('"10.0.0.', cast(n_nationkey as string), '"') end, ']}}}')"""
PATH = VIEWS["fx_tree"].split("select ", 1)[1].split(" as path", 1)[0]

Query = tuple[Callable[[Views], DataFrame], str | None]

CATALOG: dict[str, Query] = {
    "status_classify": (
        lambda v: status.classify(v.fx_tree, v.fx_lock),
        "select coalesce(t.path,l.path) as path, case when l.path is null or l.deleted then 'local-only' when t.path is null then 'orphaned' when t.sha256=l.sha256 then 'pushed' else 'drifted' end as state, coalesce(t.sha256,l.sha256) as sha256 from @fx_tree t full outer join @fx_lock l on t.path=l.path where t.path is not null or not l.deleted",
    ),
    "status_blob_missing": (lambda v: status.blob_missing(v.fx_tree, v.fx_lock, v.fx_objects), "select t.path, t.sha256 from @fx_tree t join @fx_lock l on t.path = l.path and t.sha256 = l.sha256 where not l.deleted and t.sha256 not in (select object_key from @fx_objects)"),
    "lock_merge": (
        lambda v: locks.merge(v.fx_lock, v.fx_lock_theirs).select("path", "sha256", "deleted"),
        """select coalesce(o.path,t.path) as path, case when o.path is null then t.sha256 when t.path is null then o.sha256 when o.sha256=t.sha256 then o.sha256 when t.pushed_at_s>o.pushed_at_s then t.sha256 when o.pushed_at_s>t.pushed_at_s then o.sha256 else greatest(o.sha256,t.sha256) end as sha256,
         case when o.path is null then t.deleted when t.path is null then o.deleted when o.sha256=t.sha256 then o.deleted and t.deleted when t.pushed_at_s>o.pushed_at_s then t.deleted when o.pushed_at_s>t.pushed_at_s then o.deleted when t.sha256>o.sha256 then t.deleted else o.deleted end as deleted from @fx_lock o full outer join @fx_lock_theirs t on o.path=t.path""",
    ),
    "lock_merge_versions": (
        lambda v: _long(locks.merge(_lock_v(v, "fx_lock"), _lock_v(v, "fx_lock_theirs")).select("path", F.posexplode("versions").alias("pos", "sha256")), "pos"),
        """with a as (select path, o.sha256 as o, t.sha256 as t, o.history as oh, t.history as th, o.path is not null as op, t.path is not null as tp, t.pushed_at_s > o.pushed_at_s or (t.pushed_at_s = o.pushed_at_s and t.sha256 > o.sha256) as tw, sha(concat(path,'#v1')) as v1 from @fx_lock o full join @fx_lock_theirs t using (path)),
         b as (select path, case when oh then [o, v1] else cast([] as varchar[]) end as ov, case when th then [t, v1] else cast([] as varchar[]) end as tv, coalesce(tw and o <> t, false) as tw from a),
         c as (select path, case when tw then list_concat(tv, ov) else list_concat(ov, tv) end as l from b), d as (select path, unnest(l) as sha256, unnest(range(len(l))) as i from c),
         e as (select path, sha256, min(i) as i from d group by path, sha256) select path, row_number() over (partition by path order by i) - 1 as pos, sha256 from e""",
    ),
    "referenced_shas": (lambda v: locks.referenced(v.fx_lock, v.fx_lock_version), "select sha256 from @fx_lock union select sha256 from @fx_lock_version"),
    "keep_set": (
        lambda v: locks.referenced(v.fx_lock, v.fx_lock_version).union(v.fx_lock_theirs.select("sha256")).distinct(),
        "select sha256 from @fx_lock union select sha256 from @fx_lock_version union select sha256 from @fx_lock_theirs",
    ),
    "preserve_set": (lambda v: locks.referenced(v.fx_lock, v.fx_lock_version, preserved_only=True), f"with {KEEP} select sha256 from pres"),
    "gc_plan": (lambda v: gc.mark(v.fx_objects, locks.referenced(v.fx_lock, v.fx_lock_version)), "with keep as (select sha256 from @fx_lock union select sha256 from @fx_lock_version) select o.object_key, case when k.sha256 is not null then 'kept' else 'eligible' end as verdict from @fx_objects o left join keep k on o.object_key=k.sha256"),
    "gc_plan_preserve": (
        lambda v: gc.mark(v.fx_objects, v.fx_branch.where("not preserve"), locks.referenced(v.fx_lock, v.fx_lock_version, preserved_only=True)),
        f"with {KEEP} select object_key, case when object_key in (select sha256 from @fx_branch where not preserve) then 'kept' when object_key in (select sha256 from pres) then 'preserved' else 'eligible' end as verdict from @fx_objects",
    ),
    "gc_plan_federated": (
        lambda v: gc.mark_federated(v.fx_objects, v.fx_catalog, v.fx_branch, locks.referenced(v.fx_lock, v.fx_lock_version, preserved_only=True), v.fx_pending),
        f"with {KEEP}, {GIT} select object_key, case when object_key in (select sha256 from @fx_branch) then 'kept' when object_key in (select sha256 from pres) then 'preserved' when git.id in (select id from @fx_pending) then 'pending' else 'eligible' end as verdict from @fx_objects join git on object_key = git.sha256",
    ),
    "gc_pending_skip": (
        lambda v: gc.mark_federated(v.fx_objects, v.fx_catalog, v.fx_branch, locks.referenced(v.fx_lock, v.fx_lock_version, preserved_only=True), v.fx_pending).groupBy("verdict").agg(F.count("*").alias("n")),
        f"with {KEEP}, {GIT} select verdict, count(*) as n from (select case when object_key in (select sha256 from @fx_branch) then 'kept' when object_key in (select sha256 from pres) then 'preserved' when git.id in (select id from @fx_pending) then 'pending' else 'eligible' end as verdict from @fx_objects join git on object_key = git.sha256) x group by verdict",
    ),
    "gc_forget": (
        lambda v: gc.forget(v.fx_catalog, gc.mark_federated(v.fx_objects, v.fx_catalog, v.fx_branch, locks.referenced(v.fx_lock, v.fx_lock_version, preserved_only=True), v.fx_pending).where("verdict = 'eligible'").select(F.col("object_key").alias("sha256"))).select("member", "path", "sha256"),
        f"with {KEEP}, {GIT} select member, path, sha256 from @fx_catalog where sha256 not in (select object_key from @fx_objects join git on object_key = git.sha256 where object_key not in (select sha256 from @fx_branch) and object_key not in (select sha256 from pres) and git.id not in (select id from @fx_pending))",
    ),
    "verify_corrupt": (lambda v: locks.corrupt(v.fx_objects), "select object_key, observed_sha from @fx_objects where object_key <> observed_sha"),
    "verify_missing": (
        lambda v: locks.missing(v.fx_lock, v.fx_lock_version, v.fx_objects),
        "select sha256, count(distinct path) as n_paths, min(path) as first_path from (select path,sha256 from @fx_lock union select path,sha256 from @fx_lock_version) k where sha256 not in (select object_key from @fx_objects) group by sha256",
    ),
    "referencing_paths": (lambda v: locks.paths_of(v.fx_lock, v.fx_lock_version), "select sha256, count(distinct path) as n_paths, min(path) as first_path from (select path,sha256 from @fx_lock union select path,sha256 from @fx_lock_version) k group by sha256"),
    "three_way_findings": (lambda v: scan.three_way(_lock_ids(v), v.fx_catalog, v.fx_disk, v.fx_pending, _certified()), f"with {THREE} select path, kind from three"),
    "three_way_exit_code": (
        lambda v: _long(scan.worst(scan.three_way(_lock_ids(v), v.fx_catalog, v.fx_disk, v.fx_pending, _certified())), "exit_code"),
        f"with {THREE} select cast(max(case when kind = 'chain-broken' then 6 when kind in ('corrupt','missing-on-disk','genesis-invalid','field-mismatch','lock-only','catalog-missing') then 5 else 0 end) as bigint) as exit_code from three",
    ),
    "scan_diff": (lambda v: scan.diff(v.fx_catalog, v.fx_disk), f"with {DIFF} select path, kind, sha256, old_path from changes"),
    "scan_moves": (lambda v: scan.diff(v.fx_catalog, v.fx_disk).where("kind = 'moved'").select("old_path", "path"), f"with {DIFF} select old_path, path from changes where kind = 'moved'"),
    "scan_counts": (lambda v: scan.counts(scan.diff(v.fx_catalog, v.fx_disk)), f"with {DIFF} select kind, count(*) as n from changes group by kind"),
    "scan_operations": (
        lambda v: scan.to_operations(scan.diff(v.fx_catalog, v.fx_disk)).select("path", "op_type", F.coalesce(F.element_at("args", F.lit("content_sha256")), F.element_at("args", F.lit("new_sha256")), F.element_at("args", F.lit("from"))).alias("detail")),
        f"with {DIFF} select path, case kind when 'added' then 'ingest' when 'edited' then 'scan' when 'moved' then 'move' else 'delete' end as op_type, case kind when 'added' then sha256 when 'edited' then sha256 when 'moved' then old_path end as detail from changes where kind in ('added','edited','moved','deleted')",
    ),
    "push_plan": (
        lambda v: status.push_plan(_tree_r(v), v.fx_lock, v.fx_objects),
        f"""with {TREE_R}, {RENAMES}, j as (select coalesce(t.path, l.path) as path, t.sha256 as t, l.sha256 as l, l.deleted, l.history, l.preserve from tr t full join @fx_lock l on t.path = l.path),
         p as (select *, case when t = l and not deleted then 'unchanged' when t is not null and path in (select new_path from ren) then 'renamed' when t is not null and t in (select object_key from @fx_objects) then 'deduped' when t is not null then 'uploaded' when path in (select old_path from ren) then 'renamed-away' when deleted then 'tombstone' when not preserve then 'dropped' else 'tombstoned' end as action from j)
         select path, action, coalesce(t, l) as sha256, l as old_sha256, action = 'dropped' or coalesce(action in ('deduped','uploaded') and l <> t and not history and not preserve, false) as gc from p""",
    ),
    "push_renames": (lambda v: status.renames(_tree_r(v), v.fx_lock), f"with {TREE_R}, {RENAMES} select old_path, new_path, sha256 from ren"),
    "push_lock": (
        lambda v: pipelines.push(_tree_r(v), v.fx_lock, v.fx_objects, "node-9", 1800000000).table.select("path", "sha256", "location", "pushed_at_s", "deleted"),
        f"""with {TREE_R}, {RENAMES}, j as (select t.path, t.sha256, l.sha256 as l, l.deleted, l.location, l.pushed_at_s from tr t left join @fx_lock l on t.path = l.path)
         select path, sha256, location, pushed_at_s, false as deleted from j where sha256 = l and not deleted union all select path, sha256, 'node-9', 1800000000, false from j where not coalesce(sha256 = l and not deleted, false) and path not in (select new_path from ren)
         union all select r.new_path, l.sha256, l.location, l.pushed_at_s, false from ren r join @fx_lock l on l.path = r.old_path
         union all select path, sha256, location, pushed_at_s, true from @fx_lock where path not in (select path from tr) and path not in (select old_path from ren) and (deleted or preserve)""",
    ),
    "pull_plan": (lambda v: status.pull_plan(v.fx_tree, v.fx_lock), "select path, sha256, location from @fx_lock l where not deleted and not exists (select 1 from @fx_tree t where t.path = l.path and t.sha256 = l.sha256)"),
    "rules_managed": (
        lambda v: v.fx_tree.select("path", globs.evaluate(F.col("path"), F.col("size"), **RULES).alias("r")).select("path", "r.*"),
        f"""select path, m as managed, case when not m then false when regexp_matches(path, '{RX_OV[0]}') then true when regexp_matches(path, '{RX_OV[1]}') then true when regexp_matches(path, '{RX_OV[2]}') then false else false end as history,
         case when not m then false when regexp_matches(path, '{RX_OV[0]}') then true when regexp_matches(path, '{RX_OV[1]}') then false when regexp_matches(path, '{RX_OV[2]}') then true else false end as preserve
         from (select path, (size >= 4096 or regexp_matches(path, '{RX_IN}')) and not regexp_matches(path, '{RX_EX}') as m from @fx_tree) x""",
    ),
    "rules_first_override": (
        lambda v: _long(v.fx_tree.select("path", globs.first_override(F.col("path"), [o[0] for o in RULES["overrides"]]).alias("override")), "override"),
        f"select path, cast(case when regexp_matches(path, '{RX_OV[0]}') then 0 when regexp_matches(path, '{RX_OV[1]}') then 1 when regexp_matches(path, '{RX_OV[2]}') then 2 end as bigint) as override from @fx_tree",
    ),
    "ignore_last_match": (
        lambda v: v.fx_tree.select("path", globs.ignored(F.col("path"), globs.parse_ignore(IGNORE), F.col("doc_id") % 25 == 2).alias("ignored")),
        r"select path, doc_id % 25 <> 2 and case when regexp_matches(path, '^src4/de/[^/]*\.pdf$') then false when regexp_matches(path, '^src5/en/[^/]*\.md$') then false when regexp_matches(path, '^src5/.*$') then true when regexp_matches(path, '^src4(/.*)?$') then true when regexp_matches(path, '^(.*/)?[^/]*\.tmp$') then true else false end as ignored from @fx_tree",
    ),
    "untracked_glob": (
        lambda v: v.fx_disk.where(~globs.reserved(F.col("path")) & globs.any_match(["new/*[05]", "src{1,2}/**"], F.col("path"))).select("path").join(v.fx_catalog.select("path"), "path", "left_anti"),
        "select path from @fx_disk where (regexp_matches(path, '^new/[^/]*[05]$') or regexp_matches(path, '^src[12]/.*$')) and path not in (select path from @fx_catalog)",
    ),
    "roster_merge": (lambda v: federation.merge_rosters(v.fx_roster), f"with {MERGED} select name, joined_at_s, status from merged"),
    "roster_active": (lambda v: federation.active(federation.merge_rosters(v.fx_roster)).select("name"), f"with {MERGED} select name from merged where status = 'active'"),
    "roster_signature": (lambda v: federation.signature(v.fx_roster, "observer"), "select observer, string_agg(concat(name,':',status), ',' order by concat(name,':',status)) as signature from @fx_roster group by observer"),
    "roster_divergent": (
        lambda v: federation.divergent(v.fx_roster),
        f"with {MERGED} select observer, string_agg(concat(name,':',status), ',' order by concat(name,':',status)) <> (select string_agg(concat(name,':',status), ',' order by concat(name,':',status)) from merged) as divergent from @fx_roster group by observer",
    ),
    "roster_unregistered": (lambda v: federation.unregistered(federation.merge_rosters(v.fx_roster), v.fx_registry).select("name"), f"with {MERGED} select name from merged where name not in (select name from @fx_registry)"),
    "wal_state": (
        lambda v: wal.effective_state(v.fx_wal.select("member", "seq", "op_id"), v.fx_marker).select("op_id", "state"),
        "select op_id, case when (seq % 3 > 0 and seq % 4 = 0) or seq % 5 = 0 then 'done' when seq % 3 > 0 then 'failed' else 'intent' end as state from @fx_wal",
    ),
    "wal_pending": (lambda v: wal.pending(v.fx_wal).groupBy("member", "op_type").agg(F.count("*").alias("n")), "select member, op_type, count(*) as n from @fx_wal where state='intent' group by member, op_type"),
    "wal_chain_breaks": (lambda v: _long(wal.chain_breaks(v.fx_chain), "seq"), f"with {BREAKS} select member, seq, problem from brk where problem is not null"),
    "wal_prune_prefix": (
        lambda v: _long(wal.prunable(v.fx_wal.withColumn("state", F.when((F.col("seq") < 40) | (F.col("state") == "done"), "done").otherwise(F.col("state"))), F.lit("2030-01-01").cast("timestamp")), "seq"),
        "select member, seq from @fx_wal w where seq < (select min(seq) from @fx_wal x where x.member = w.member and x.seq >= 40 and x.state <> 'done')",
    ),
    "wal_next_slot": (lambda v: _long(wal.next_slot(v.fx_chain), "seq"), "select member, max(seq) + 1 as seq, max_by(self_hash, seq) as prev_hash from @fx_chain group by member"),
    "wal_anchor": (lambda v: _long(wal.anchors(v.fx_prune), "seq"), "select member, max(seq) as seq, max_by(hash, seq) as hash from @fx_prune group by member"),
    "ops_waits_on": (lambda v: wal.waits_on(v.fx_wal), f"with {WAITS} select member, op_id, n_waits from waits"),
    "ops_sweep": (
        lambda v: wal.sweep(v.fx_wal, v.fx_chain.where("member = 'node-2'")).select("member", "op_id", "op_type", "state", "n_waits"),
        f"with {WAITS} select w.member, w.op_id, w.op_type, w.state, n_waits from @fx_wal w join waits on w.member = waits.member and w.op_id = waits.op_id where w.member <> 'node-2' and w.state <> 'done'",
    ),
    "ops_retryable": (
        lambda v: wal.retryable(wal.sweep(v.fx_wal, v.fx_chain.where("member = 'node-2'")), {"node-0": "local", "node-1": "ssh", "node-3": "share", "node-4": "ssh"}),
        f"with {WAITS} select w.member, w.op_id, case when n_waits > 0 then 'waits' when op_type in ('ingest','scan','move','delete') and w.member in ('node-0','node-3') then 'replay' else 'refused' end as verdict from @fx_wal w join waits on w.member = waits.member and w.op_id = waits.op_id where w.member <> 'node-2' and w.state <> 'done'",
    ),
    "forward_latest": (lambda v: federation.latest_forward(v.fx_moves), f"with {FORWARD} select member, id, moved_to, pending from fwd"),
    "resolve_outcome": (lambda v: _long(_moves_state(v).withColumn("exit_code", scalars.exit_code(F.col("outcome"))), "exit_code"), f"with recursive {RESOLVE} select id, outcome, member, pointer, cast(case when outcome like 'found%' then 0 when outcome = 'missing' then 5 when outcome = 'partial-view' then 6 else 1 end as bigint) as exit_code from res"),
    "resolve_chain": (
        lambda v: federation.resolve(v.fx_query_moved, v.fx_held, v.fx_moves, v.fx_members.withColumn("answered", F.lit(True))).select("id", "outcome", "member"),
        f"with recursive {RESOLVE.replace('@fx_members', 'mem').replace('@fx_query', 'qry')} select id, outcome, member from res".replace("with recursive fwd", "with recursive mem as (select name, status, true as answered from @fx_members), qry as (select * from @fx_query_moved), fwd"),
    ),
    "id_prefix_lookup": (
        lambda v: federation.id_prefix(v.fx_catalog, v.fx_members, v.fx_prefix),
        "with u as (select distinct id from @fx_catalog where member in (select name from @fx_members where answered)), n as (select prefix, count(u.id) as n_ids, min(u.id) as id from @fx_prefix left join u on starts_with(u.id, prefix) group by prefix) select prefix, n_ids, case when n_ids = 1 then 'found' when n_ids > 1 then 'ambiguous' else 'partial-view' end as verdict, case when n_ids = 1 then id end as id from n",
    ),
    "heal_plan": (
        lambda v: federation.heal(v.fx_query.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), "id", F.concat(F.lit("node-"), (F.col("doc_id") % 3).cast("string")).alias("location")), _moves_state(v)),
        f"with recursive {RESOLVE}, e as (select concat('p', cast(doc_id as string)) as path, id, concat('node-', cast(doc_id % 3 as string)) as location from @fx_query) select path, case when outcome like 'found%' then case when member = location then 'at-home' else 'healed' end when outcome = 'missing' then 'missing' else 'partial' end as verdict, case when outcome like 'found%' then member else location end as location from e join res on e.id = res.id",
    ),
    "member_listing": (
        lambda v: federation.listing(v.fx_catalog, v.fx_members, prefix="src1"),
        "select member, path, concat(member,'/',path) as logical_path, sync_mode, size from @fx_catalog where starts_with(path, 'src1') and member in (select name from @fx_members where status = 'active' and answered)",
    ),
    "member_totals": (lambda v: federation.totals(v.fx_catalog), "select member, count(*) as n_files, cast(sum(size) as bigint) as n_bytes from @fx_catalog group by member"),
    "fed_status": (
        lambda v: federation.status(v.fx_members, v.fx_pending, v.fx_catalog, v.fx_snapshot),
        "select name, status, answered as reachable, case when answered then (select count(*) from @fx_pending p where p.member = name) end as n_pending, case when answered then (select count(*) from @fx_catalog c where c.member = name) else (select cast(min(file_count) as bigint) from @fx_snapshot s where s.name = m.name and generation = 0) end as n_files, not answered as cached from @fx_members m",
    ),
    "last_known": (lambda v: _long(federation.last_known(v.fx_snapshot), "generation", "file_count"), "select name, cast(generation as bigint) as generation, cast(file_count as bigint) as file_count from @fx_snapshot where generation = 0"),
    "mint_ids": (
        lambda v: v.fx_tree.select("path", identity.mint_id({"content_sha256": F.col("sha256"), "original_path": F.concat("path", F.lit('\t"q"\\')), "ingest_op_id": F.lit("op"), "origin_node": F.lit("n")}).alias("id")),
        """select path, sha(concat('content_sha256 = "',sha256,'"',chr(10),'original_path = "',path,'\\t\\"q\\"\\\\','"',chr(10),'ingest_op_id = "op"',chr(10),'origin_node = "n"',chr(10))) as id from @fx_tree""",
    ),
    "self_cert_violations": (
        lambda v: v.fx_catalog.where(~_certified()).select("path", "id"),
        """select path, id from @fx_catalog where id <> sha(concat('content_sha256 = "',content_sha256,'"',chr(10),'original_path = "',original_path,'"',chr(10),'ingest_op_id = "',ingest_op_id,'"',chr(10),'origin_node = "',origin_node,'"',chr(10)))""",
    ),
    "op_ids": (
        lambda v: v.fx_tree.select("path", identity.op_id(F.lit("rm"), F.col("path"), F.col("sha256")).alias("op_id")),
        "select path, substr(h,1,12) || '4' || substr(h,14,3) || translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr(h,18,15) as op_id from (select path, sha('rm' || chr(0) || path || chr(0) || sha256) as h from @fx_tree) x",
    ),
    "path_ids": (lambda v: v.fx_tree.select("path", identity.path_id(F.concat(F.lit("./x/..//"), "path")).alias("id")), "select path, sha(path) as id from @fx_tree"),
    "size_parse": (
        lambda v: v.part.select("p_partkey", F.get(F.array(*map(F.lit, SIZES)), (F.col("p_partkey") % len(SIZES)).cast("int")).alias("text")).select("p_partkey", "text", scalars.parse_size(F.col("text")).alias("n")),
        f"select p_partkey, {SIZES!r}[1 + p_partkey % {len(SIZES)}] as text, cast([{', '.join('null' if b is None else str(b) for b in SIZE_BYTES)}][1 + p_partkey % {len(SIZES)}] as bigint) as n from @part",
    ),
    "human_bytes": (
        lambda v: v.part.select("p_partkey", scalars.human_bytes(F.floor(F.pow(F.lit(1.7), F.col("p_partkey") % 70)).cast("long")).alias("text")),
        "select p_partkey, case when n < 1024 then n::varchar || ' B' when n < 1048576 then printf('%.1f KiB', n / 1024.0::double) when n < 1073741824 then printf('%.1f MiB', n / 1048576.0::double) when n < 1099511627776 then printf('%.1f GiB', n / 1073741824.0::double) else printf('%.1f TiB', n / 1099511627776.0::double) end as text from (select p_partkey, cast(floor(pow(1.7, p_partkey % 70)) as bigint) as n from @part) x",
    ),
    "semver_newer": (
        lambda v: v.sql(f"select * from {SEMVERS} x").select("p_partkey", scalars.newer(F.col("a"), F.col("b")).alias("newer")),
        rf"""select p_partkey, coalesce(case when regexp_matches(a, '^v?[0-9]+\.[0-9]+\.[0-9]+(-.*)?$') then row(regexp_extract(a, '^v?([0-9]+)', 1)::int, regexp_extract(a, '^v?[0-9]+\.([0-9]+)', 1)::int, regexp_extract(a, '^v?[0-9]+\.[0-9]+\.([0-9]+)', 1)::int) end < row(1, regexp_extract(b, '^1\.([0-9]+)', 1)::int, 3), false) as newer from {SEMVERS} x""",
    ),
    "age_text": (
        lambda v: v.fx_lock.select("path", scalars.age_text(F.lit(1704080000) - F.col("pushed_at_s") * F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0) - F.when(F.col("doc_id") % 2 == 1, 1704080000 - F.col("doc_id") * 997).otherwise(0)).alias("age")),
        "select path, case when s < 60 then s::varchar || 's' when s < 3600 then (s // 60)::varchar || 'm' when s < 86400 then (s // 3600)::varchar || 'h' else (s // 86400)::varchar || 'd' end as age from (select path, greatest(0, case when doc_id % 2 = 0 then 1704080000 - pushed_at_s else doc_id * 997 end) as s from @fx_lock) x",
    ),
    "version_history": (
        lambda v: _long(locks.version_history(v.fx_wal.select("path", F.substring("content_sha256", 1, 1).alias("sha256"), F.col("event_id").alias("at"))), "pos"),
        "with w as (select path, event_id, substr(content_sha256, 1, 1) as sha256, lag(substr(content_sha256, 1, 1)) over (partition by path order by event_id) as was from @fx_wal) select path, row_number() over (partition by path order by event_id desc) - 1 as pos, sha256 from w where was is null or was <> sha256",
    ),
    "revert_check": (
        lambda v: locks.revert_check(v.fx_tree.select("path", F.when(F.col("doc_id") % 3 == 0, F.sha2(F.concat("path", F.lit("#v1")), 256)).otherwise(F.col("sha256")).alias("sha256")), v.fx_lock, v.fx_lock_version),
        "select w.path, w.sha256, case when l.path is null or l.deleted then 'no-entry' when not l.history then 'history-off' when l.sha256 = w.sha256 then 'current' when not exists (select 1 from @fx_lock_version v where v.path = w.path and v.sha256 = w.sha256) then 'not-a-version' else 'ok' end as verdict from (select path, case when doc_id % 3 = 0 then sha(concat(path,'#v1')) else sha256 end as sha256 from @fx_tree) w left join @fx_lock l on w.path = l.path",
    ),
    "blob_refcount": (lambda v: gc.reference_counts(v.fx_catalog), "select member, sha256, count(*) as n, count(*) <= 1 as last from @fx_catalog group by member, sha256"),
    "free_dedup_path": (
        lambda v: scan.free_names(v.sql("select concat('d/f', cast(doc_id % 20 as string), '.x') as path from @fx_tree group by all"), v.sql("select case when doc_id % 5 = 0 then concat('d/f', cast(doc_id % 20 as string), '.x') else concat('d/f', cast(doc_id % 20 as string), ' (', cast(doc_id % 9 as string), ').x') end as path from @fx_tree group by all")),
        """with w as (select distinct concat('d/f', cast(doc_id % 20 as string), '.x') as path, concat('d/f', cast(doc_id % 20 as string)) as stem from @fx_tree), c as (select distinct case when doc_id % 5 = 0 then concat('d/f', cast(doc_id % 20 as string), '.x') else concat('d/f', cast(doc_id % 20 as string), ' (', cast(doc_id % 9 as string), ').x') end as path from @fx_tree)
         select path, case when path in (select path from c) then (select min(stem || ' (' || n || ').x') from (select stem, min(n) as n from (select unnest(range(2, 20)) as n) r where (w.stem || ' (' || n || ').x') not in (select path from c)) y) else path end as free from w""",
    ),
    "bootstrap_progress": (
        lambda v: lookup.progress(v.fx_catalog),
        "select member, path, cast(sum(size) over (partition by member order by path rows unbounded preceding) as bigint) as done_bytes, count(*) over (partition by member order by path rows unbounded preceding) as done_files from @fx_catalog",
    ),
    "pointer_roundtrip": (
        lambda v: v.fx_lock.select("path", identity.pointer_text(F.col("sha256"), F.col("size"), F.col("location"), MAGIC).alias("text")).select("path", "text", identity.is_pointer(F.col("text"), MAGIC).alias("sniffed"), identity.pointer(F.col("text"), MAGIC).alias("p")).select("path", "text", "sniffed", "p.*"),
        "select path, concat('blob.v1',chr(10),'sha256 ',sha256,chr(10),'size ',cast(size as string),chr(10),'location ',location,chr(10)) as text, true as sniffed, sha256, size, location from @fx_lock",
    ),
    "catalog_projection_nomove": (
        lambda v: projection.project_without_moves(v.fx_wal),
        """with d as (select *, max(case when op_type in ('ingest','delete') then seq end) over (partition by member,path) as b from @fx_wal where state='done' and op_type<>'move'), a as (select member,path,max(case when seq=b then op_type end) as btype, max(b) as b, max(case when op_type in ('ingest','scan') and seq>=b then seq end) as sseq from d where b is not null group by member,path)
         select a.member,a.path,d.content_sha256 as sha256 from a join d on d.member=a.member and d.path=a.path and d.seq=a.sseq where a.btype='ingest'""",
    ),
    "catalog_projection_full": (lambda v: projection.project(_wal_args(v)).select("member", "path", "id", "sha256", "sync_mode", "size"), None),
    "wal_append_batch": (_appended, APPEND),
    "ingest_plan": (
        lambda v: pipelines.ingest(v.fx_disk, "node-1", v.fx_wal.select("op_id")).select("path", "op_id", "id"),
        """select path, op_id, sha(concat('content_sha256 = "',sha256,'"',chr(10),'original_path = "',path,'"',chr(10),'ingest_op_id = "',op_id,'"',chr(10),'origin_node = "node-1"',chr(10))) as id from (select path, sha256, substr(h,1,12) || '4' || substr(h,14,3) || translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr(h,18,15) as op_id from (select path, sha256, sha('ingest' || chr(0) || 'node-1' || chr(0) || path || chr(0) || sha256) as h from @fx_disk) x) y""",
    ),
    "track_plan": (
        lambda v: pipelines.track(v.fx_tree.select("path"), v.fx_catalog_tracked, v.fx_disk),
        "select t.path, case when d.path is null then 'missing' when c.path is null then 'tracked' when c.sha256 = d.sha256 then 'already' else 'drifted' end as verdict from @fx_tree t left join @fx_catalog_tracked c on t.path = c.path left join @fx_disk d on t.path = d.path",
    ),
    "sync_mode_change": (
        lambda v: pipelines.set_sync_mode(v.fx_catalog, v.fx_lock.select("path", F.when(F.col("doc_id") % 4 == 0, "odd").otherwise("git").alias("to_mode"))).report.select("path", "to_mode", "verdict"),
        "select l.path, l.to_mode, case when c.path is null then 'no-file' when l.to_mode = 'odd' then 'not-settable' when c.sync_mode = l.to_mode then 'same' else 'changed' end as verdict from (select path, case when doc_id % 4 = 0 then 'odd' else 'git' end as to_mode from @fx_lock) l left join @fx_catalog c on l.path = c.path",
    ),
    "move_plan": (
        lambda v: pipelines.move(v.fx_catalog, v.fx_move).table.select("member", "path", "id"),
        """with r as (select *, row_number() over (partition by to_path order by member, path) as n from @fx_move)
         select case when r.n = 1 then 'node-0' else c.member end as member, case when r.n = 1 then r.to_path else c.path end as path, c.id from @fx_catalog c left join r on c.member = r.member and c.path = r.path""",
    ),
}

CATALOG |= {
    "lock_validate": (
        lambda v: schemas.lock_problems(v.fx_catalog.select("path", F.when(F.col("doc_id") % 4 > 0, F.col("id")).alias("id"), F.when(F.col("doc_id") % 5 > 0, F.struct(*identity.GENESIS[:2], F.when(F.col("doc_id") % 11 > 0, F.col("ingest_op_id")).alias("ingest_op_id"), "origin_node")).alias("genesis"))),
        f"select path, problem from (select path, case when doc_id % 4 > 0 and doc_id % 5 = 0 then 'id-without-genesis' when doc_id % 4 = 0 and doc_id % 5 > 0 then 'genesis-without-id' when doc_id % 4 > 0 and doc_id % 11 = 0 then 'genesis-incomplete' when doc_id % 4 > 0 and id <> {GENESIS_SHA} then 'id-mismatch' end as problem from @fx_catalog) x where problem is not null",
    ),
    "catalog_validate": (
        lambda v: schemas.catalog_problems(v.fx_catalog.select("member", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 7 == 0, F.upper("id")).otherwise(F.col("id")).alias("id"))),
        "select member, path, id, problem from (select member, case when doc_id % 9 = 0 then '' else path end as path, case when doc_id % 7 = 0 then upper(id) else id end as id, case when doc_id % 9 = 0 then 'path' when doc_id % 7 = 0 and id <> upper(id) then 'id' end as problem from @fx_catalog) x where problem is not null",
    ),
    "location_validate": (
        lambda v: schemas.location_problems(v.supplier.select(F.col("s_name").alias("name"), *[F.expr(x) for x in LOCATION])),
        f"""select name, problem from (select *, case when base_path = '' then 'base_path' when backend not in ('local','ssh','share') then 'backend' when backend = 'local' then (case when node <> '' or "user" <> '' or share <> '' then 'local-takes-only-base_path' end) when node = '' then 'node' when backend = 'ssh' and "user" = '' then 'user' when backend = 'share' and share = '' then 'share' end as problem from (select s_name as name, {', '.join(LOCATION).replace('as user', 'as "user"')} from @supplier) y) x where problem is not null""",
    ),
    "peers_online": (
        lambda v: federation.online(files.peers(v.nation.select(F.expr(PEER).alias("value")))),
        "select case when n_nationkey % 4 = 0 then '10.0.0.' || n_nationkey else n_name end as name, n_name || '.net' as dns from @nation where n_nationkey % 3 > 0 and not (n_nationkey % 4 = 0 and n_nationkey % 8 = 0)",
    ),
    "last_known_holders": (
        lambda v: _long(federation.last_known_holders(v.fx_known.groupBy("name", F.col("generation").cast("int").alias("generation")).agg(F.collect_list("id").alias("ids")), v.fx_wanted_id), "generation"),
        "select id, name, cast(generation as bigint) as generation from @fx_known where generation < 2 and id in (select id from @fx_wanted_id)",
    ),
    "heal_counts": (
        lambda v: federation.verdict_counts(federation.heal(v.fx_query.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), "id", F.concat(F.lit("node-"), (F.col("doc_id") % 3).cast("string")).alias("location")), _moves_state(v))),
        f"with recursive {RESOLVE} select verdict, count(*) as n from (select case when outcome like 'found%' then case when member = concat('node-', cast(q.doc_id % 3 as string)) then 'at-home' else 'healed' end when outcome = 'missing' then 'missing' else 'partial' end as verdict from @fx_query q join res on q.id = res.id) x group by verdict",
    ),
    "fetch_plan": (
        lambda v: federation.fetch_plan(v.fx_catalog.select("id", F.when(F.col("doc_id") % 6 == 0, "nowhere").otherwise(F.col("member")).alias("member"), F.lit("found-at-home").alias("outcome")), v.fx_catalog, v.fx_objects),
        "select id, case when doc_id % 6 = 0 then 'nowhere' else member end as member, case when doc_id % 6 = 0 then 'not-found' when o.object_key is null then 'no-bytes' when o.observed_sha = c.sha256 then 'ok' when sync_mode = 'git' then 'corrupt' else 'drifted' end as verdict from @fx_catalog c left join @fx_objects o on c.sha256 = o.object_key",
    ),
    "target_parse": (
        lambda v: v.fx_catalog.select("path", F.when(F.col("doc_id") % 3 == 0, F.upper(F.expr("substring(id, 1, cast(8 + doc_id % 9 as int))"))).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "member", "path")).otherwise(F.concat("member", F.lit("/"))).alias("text")).select("path", scalars.target(F.col("text")).alias("t")).select("path", "t.id", "t.member", F.col("t.path").alias("rel")),
        "select path, case when doc_id % 3 = 0 and doc_id % 9 >= 4 then substr(id, 1, 8 + doc_id % 9) end as id, case when doc_id % 3 = 1 then member end as member, case when doc_id % 3 = 1 then path end as rel from @fx_catalog",
    ),
    "gc_sweep": (lambda v: gc.sweep(v.fx_objects, gc.mark(v.fx_objects, locks.referenced(v.fx_lock, v.fx_lock_version))).select("object_key"), "select object_key from @fx_objects where object_key in (select sha256 from @fx_lock union select sha256 from @fx_lock_version)"),
    "remove_plan": (
        lambda v: pipelines.remove(v.fx_catalog, v.fx_removed, True).report,
        """with g as (select member, path, sha256 from @fx_catalog where doc_id % 4 = 1), c as (select g.*, (select count(*) from @fx_catalog x where x.member = g.member and x.sha256 = g.sha256 and x.doc_id % 4 <> 1) as stay, row_number() over (partition by member, sha256 order by path desc) as r from g)
         select member, path, case when stay = 0 and r = 1 then 'bytes' else 'row' end as verdict from c union all select 'node-1', 'nowhere', 'no-file'""",
    ),
    "restore_identity": (
        lambda v: pipelines.restore_identity(v.fx_catalog, v.fx_catalog_back.select(F.when(F.col("doc_id") % 5 == 1, F.lit("nowhere")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 7 == 1, identity.mint_id({**{k: F.col(k) for k in identity.GENESIS}, "origin_node": F.lit("old")})).otherwise(F.col("id")).alias("restored_id"), *identity.GENESIS[:3], F.when(F.col("doc_id") % 7 == 1, "old").otherwise(F.col("origin_node")).alias("origin_node"))).report.select("path", "verdict"),
        f"select case when doc_id % 5 = 1 then 'nowhere' else path end as path, case when doc_id % 7 <> 1 and id <> {GENESIS_SHA} then 'not-certified' when doc_id % 5 = 1 then 'no-file' when doc_id % 7 = 1 then 'restored' else 'already' end as verdict from @fx_catalog_back",
    ),
    "roster_change": (
        lambda v: pipelines.roster_change(v.fx_members, v.fx_members.select("name", F.when(F.col("name") < "node-2", "left").when(F.col("name") < "node-4", "evicted").otherwise("active").alias("status")), 7).report,
        "select name, status, verdict from (select name, case when name < 'node-2' then 'left' when name < 'node-4' then 'evicted' else 'active' end as status, case when name in ('node-2') then 'refused-live' else 'applied' end as verdict from @fx_members) x",
    ),
    "smudge_check": (
        lambda v: pipelines.smudge(v.documents.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), (F.octet_length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size")), v.fx_stored.select("object_key", F.col("content").cast("binary").alias("content"))).select("path", "verdict"),
        "with o as (select object_key as k, encode(content) as c from @fx_stored) select cast(d.doc_id as string) as path, case when o.k is null then 'missing' when sha256(o.c) <> o.k then 'corrupt' when octet_length(o.c) <> bytes(d.text) + (case when d.doc_id % 5 = 0 then 1 else 0 end) then 'size' else 'ok' end as verdict from @documents d left join o on sha(d.text) = o.k",
    ),
    "clean_filter": (
        lambda v: v.sql(f"select {PATH} as path, text, doc_id from @documents").select("path", F.sha2(pipelines.clean(F.col("text").cast("binary"), F.col("path"), F.octet_length("text").cast("long"), "node-1", MAGIC, **RULES), 256).alias("sha256")),
        f"select path, sha(case when (bytes(text) >= 4096 or regexp_matches(path, '{RX_IN}')) and not regexp_matches(path, '{RX_EX}') then concat('blob.v1',chr(10),'sha256 ',sha(text),chr(10),'size ',cast(bytes(text) as string),chr(10),'location node-1',chr(10)) else text end) as sha256 from (select {PATH} as path, text from @documents) x",
    ),
    "wal_encode": (
        lambda v: v.fx_wal.select("op_id", F.sha2(identity.wal_text({"seq": F.col("seq"), "op_id": F.col("op_id"), "prev_hash": F.lit("0"), "op_type": F.col("op_type"), "blob_refs": F.array("content_sha256", F.lit('q"')), "actor": F.lit("me"), "created_at": F.lit("2024-01-01T00:00:00Z"), "args": F.create_map(F.lit("path"), F.col("path"), F.lit("from"), F.lit("x"))}), 256).alias("self_hash")),
        """select op_id, sha(concat('seq = ',cast(seq as string),chr(10),'op_id = "',op_id,'"',chr(10),'prev_hash = "0"',chr(10),'op_type = "',op_type,'"',chr(10),'blob_refs = ["',content_sha256,'", "q\\""]',chr(10),'actor = "me"',chr(10),'created_at = 2024-01-01T00:00:00Z',chr(10),chr(10),'[args]',chr(10),'from = "x"',chr(10),'path = "',path,'"',chr(10))) as self_hash from @fx_wal""",
    ),
}


REFS = "refs as (select member, seq, op_id, path as ref from @fx_log where state <> 'done' union select member, seq, op_id, ref2 from @fx_log where state <> 'done'), pre as (select distinct a.member, a.op_id, b.op_id as waits_on, b.seq from refs a join refs b on a.member = b.member and a.ref = b.ref and b.seq < a.seq)"
COPIES = "values (0), (1), (2), (3)"
MOVED = """mv as (select m.*, row_number() over (partition by to_path order by member, path) as n from @fx_move m), j as (select mv.*, c.id, c.sha256, c.sync_mode, o.observed_sha, case when c.path is null then 'no-file' when n > 1 then 'conflict' when o.object_key is null then 'no-bytes' when o.observed_sha = c.sha256 then 'moved' when c.sync_mode = 'manual' then 'rehomed' else 'corrupt' end as verdict
  from mv left join @fx_catalog c on c.member = mv.member and c.path = mv.path left join @fx_objects o on o.object_key = c.sha256)"""
SWEPT = f"""{KEEP}, {GIT.replace('max_by(id, path) as id', 'max_by(id, path) as id, max_by(member, path) as member')}, doom as (select object_key, git.id, git.id in (select id from @fx_pending) as busy from @fx_objects join git on object_key = git.sha256 where object_key not in (select sha256 from @fx_branch) and object_key not in (select sha256 from pres))"""
UP = "up as (select *, row_number() over (partition by path order by member, id) as rank, path in (select path from @fx_catalog) as there from @fx_upload)"
SCANNED = """raw as (select coalesce(c.path, d.path) as path, coalesce(d.sha256, c.sha256) as sha256, case when c.path is null then 'added' when d.path is null then 'deleted' when not (d.size <> c.size or d.mtime_s > c.last_scanned_s) then null when d.sha256 = c.sha256 then 'verified' else 'edited' end as kind from @fx_catalog_1 c full join @fx_disk_1 d on c.path = d.path where c.path is null or c.sync_mode <> 'git'),
 solo as (select sha256 from raw where kind in ('added','deleted') group by sha256 having sum(case when kind = 'added' then 1 else 0 end) = 1 and sum(case when kind = 'deleted' then 1 else 0 end) = 1),
 ch as (select a.path, 'moved' as kind, a.sha256, d.path as old_path from raw a join raw d on a.sha256 = d.sha256 and a.kind = 'added' and d.kind = 'deleted' where a.sha256 in (select sha256 from solo) union all select path, kind, sha256, null from raw where kind is not null and not (kind in ('added','deleted') and sha256 in (select sha256 from solo))),
 done as (select ch.*, case when kind <> 'verified' and c.id in (select ref from @fx_log_1) then 'skipped-in-flight' else 'applied' end as verdict from ch left join @fx_catalog_1 c on c.path = coalesce(ch.old_path, ch.path))"""


def _log_1(v: Views) -> DataFrame:
    return v.fx_log_1.withColumn("blob_refs", F.array("ref"))


def _scanned(v: Views) -> pipelines.Outcome:
    return pipelines.apply_scan(v.fx_catalog_1, v.fx_disk_1, _log_1(v), "node-1", 1800000000)


def _swept(v: Views) -> pipelines.Outcome:
    plan = gc.mark_federated(v.fx_objects, v.fx_catalog, v.fx_branch, locks.referenced(v.fx_lock, v.fx_lock_version, preserved_only=True), v.fx_pending.limit(0))
    log = v.fx_pending.select("member", (F.row_number().over(_by_op()) - 1).alias("n"), "op_id", F.array("id").alias("blob_refs"), F.lit("intent").alias("state"))
    log = log.select("member", F.col("n").cast("long").alias("seq"), "op_id", F.sha2(F.concat("member", F.col("n").cast("string")), 256).alias("self_hash"), F.when(F.col("n") == 0, wal.ZERO).otherwise(F.sha2(F.concat("member", (F.col("n") - 1).cast("string")), 256)).alias("prev_hash"), "blob_refs", "state")
    return pipelines.sweep_federated(v.fx_objects, v.fx_catalog, plan, log, "run")


def _by_op():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("member").orderBy("op_id")


CATALOG |= {
    "ops_waits_on_refs": (lambda v: wal.waits_on_refs(_log(v)), f"with {REFS} select r.member, r.op_id, bool_or(p.op_id is not null) as waits, min_by(p.waits_on, p.seq) as head from (select distinct member, op_id from refs) r left join pre p on r.member = p.member and r.op_id = p.op_id group by r.member, r.op_id"),
    "ops_waits_on_ops": (lambda v: wal.waits_on_ops(_log(v)), f"with {REFS} select member, op_id, waits_on from pre"),
    "array_overlap": (lambda v: v.fx_candidate.select("position", wal.overlaps(F.array("ref1", F.lit(None)), F.array(F.concat(F.lit("u"), (F.col("position") % 60).cast("string"), F.lit("/k1")), F.lit(None), F.lit("x"))).alias("shares")), "select position, ref1 = concat('u', cast(position % 60 as varchar), '/k1') as shares from @fx_candidate"),
    "wal_verified": (
        lambda v: wal.verified(v.fx_log.unionByName(v.fx_log.select([F.when(F.col("member") == "node-3", "bad-node").otherwise("same").alias("member"), *[c for c in v.fx_log.columns if c != "member"]]).where("member = 'bad-node'").withColumn("prev_hash", F.lit("odd"))), v.fx_log_anchor).groupBy("member").agg(F.count("*").alias("n"), F.min("seq").cast("long").alias("first")),
        "select member, count(*) as n, cast(min(seq) as bigint) as first from @fx_log where seq > 20 group by member",
    ),
    "wal_next_slot_anchored": (lambda v: _long(wal.next_slot(v.fx_log.where("member <> 'node-1'"), v.fx_log_anchor), "seq"), "select member, cast(max(seq) + 1 as bigint) as seq, max_by(self_hash, seq) as prev_hash from @fx_log where member <> 'node-1' or seq = 20 group by member"),
    "wal_committed": (lambda v: wal.committed(v.fx_log.withColumn("state", F.when(F.col("member") == "node-4", "intent").otherwise(F.col("state")))), "select member, bool_or(state = 'done' and member <> 'node-4') as committed from @fx_log group by member"),
    "ops_members_attention": (lambda v: _long(wal.needing_attention(wal.chain_breaks(v.fx_chain)), "first_seq"), f"with {BREAKS} select member, cast(min(seq) as bigint) as first_seq from brk where problem is not null group by member"),
    "ops_listing": (
        lambda v: wal.ops_listing(wal.sweep(v.fx_wal, v.fx_chain.where("member = 'node-2'")), "node-3").select("op_id", "op_type", "state", "n_waits"),
        f"with {WAITS} select w.op_id, w.op_type, w.state, n_waits from @fx_wal w join waits on w.member = waits.member and w.op_id = waits.op_id where w.member = 'node-3' and w.state <> 'done'",
    ),
    "ops_pending_exit": (lambda v: _long(wal.pending_exit(wal.sweep(v.fx_wal, v.fx_chain.where("member = 'node-2'")), True), "exit_code"), "select cast(case when count(*) > 0 then 1 else 0 end as bigint) as exit_code from @fx_wal where member <> 'node-2' and state <> 'done'"),
    "ops_retry_pass": (
        lambda v: wal.retry_pass(wal.retryable(wal.sweep(v.fx_wal, v.fx_chain.where("member = 'node-2'")), {"node-0": "local", "node-1": "ssh", "node-3": "share"}), v.fx_wal.select("member", "op_id", (F.col("event_id") % 3 > 0).alias("ok"))),
        f"with {WAITS} select w.member, w.op_id, case when n_waits > 0 or op_type not in ('ingest','scan','move','delete') or w.member not in ('node-0','node-3') then 'refused' when event_id % 3 > 0 then 'done' else 'failed' end as result from @fx_wal w join waits on w.member = waits.member and w.op_id = waits.op_id where w.member <> 'node-2' and w.state <> 'done'",
    ),
    "find_first": (
        lambda v: lookup.find(v.fx_lock.select("sha256").distinct(), v.fx_catalog.select("sha256", "path", F.col("doc_id").alias("pos")), "sha256"),
        "select l.sha256, c.path is not null as found, c.path from (select distinct sha256 from @fx_lock) l left join (select sha256, min_by(path, doc_id) as path from @fx_catalog group by sha256) c on l.sha256 = c.sha256",
    ),
    "rows_last_wins": (lambda v: lookup.last_by(v.fx_wal.select("path", "op_id", F.col("event_id").alias("pos")), "path"), "select path, max_by(op_id, event_id) as op_id from @fx_wal group by path"),
    "path_lookup": (lambda v: lookup.at_path(v.fx_catalog, "node-1", "src1/en/1.stl").select("member", "path", "id"), "select member, path, id from @fx_catalog where member = 'node-1' and path = 'src1/en/1.stl'"),
    "key_exists": (lambda v: lookup.exists(v.fx_lock.select(F.col("sha256").alias("object_key")).distinct(), v.fx_objects.withColumn("size", F.length("observed_sha").cast("long"))), "select l.object_key, o.object_key is not null as there, cast(length(o.observed_sha) as bigint) as size from (select distinct sha256 as object_key from @fx_lock) l left join @fx_objects o on l.object_key = o.object_key"),
    "plan_total_bytes": (lambda v: lookup.total_bytes(v.fx_disk), "select count(*) as n_files, cast(coalesce(sum(size), 0) as bigint) as n_bytes from @fx_disk"),
    "sample_with_more": (lambda v: lookup.sample(v.fx_catalog, "path"), "select path, (select greatest(0, count(*) - 10) from @fx_catalog)::bigint as more from (select path from @fx_catalog order by path limit 10) x"),
    "deselect_by_index": (lambda v: lookup.deselect(v.fx_tree.select("path"), v.fx_tree.select((F.col("doc_id") % 37 + 1).alias("index")).distinct()).select("path", "index"), "select path, index from (select path, row_number() over (order by path) as index from @fx_tree) x where index not in (select doc_id % 37 + 1 from @fx_tree)"),
    "report_ok": (lambda v: lookup.ok(locks.corrupt(v.fx_objects)), "select count(*) = 0 as ok from @fx_objects where object_key <> observed_sha"),
    "canonical_order": (
        lambda v: lookup.in_order(v.fx_catalog.select("path"), "path").select("path", (F.monotonically_increasing_id() >= 0).alias("listed")),
        "select path, true as listed from @fx_catalog",
    ),
    "members_by_name": (lambda v: lookup.by_name(v.fx_node).select("name", "joined_at_s"), "select name, joined_at_s from @fx_node"),
    "collision_guard": (lambda v: federation.collision(_moves_state(v)), f"with recursive {RESOLVE} select id, case when outcome like 'found%' then 'collision' when outcome = 'missing' then 'ok' else 'refused' end as verdict, case when outcome like 'found%' then member end as member from res"),
    "reach_tally": (lambda v: federation.reach_tally(v.fx_node), "select count(*) filter (answered) as n_answered, count(*) as n_members, coalesce(string_agg(name, ', ' order by name) filter (not answered), '') as silent from @fx_node where status = 'active'"),
    "reach_probe": (lambda v: federation.probe(v.fx_node, v.fx_node.select("name", F.when(F.col("answered"), F.col("joined_at_s") % 10).alias("took_ms")), 6).select("name", "answered"), "select name, answered and joined_at_s % 10 <= 6 as answered from @fx_node"),
    "roster_best_effort": (
        lambda v: federation.load_roster(v.fx_roster.withColumn("fed_id", F.lit("f")), v.region.where("r_regionkey < 3").select(F.col("r_name").alias("observer"))),
        f"with {MERGED.replace('from @fx_roster)', 'from @fx_roster where observer in (select r_name from @region where r_regionkey < 3))')} select name, joined_at_s, status from merged",
    ),
    "roster_discover": (lambda v: federation.discover_roster(v.fx_roster, v.region.select(F.col("r_name").alias("observer")), via="ASIA"), "select name, joined_at_s, status from @fx_roster where observer = 'ASIA'"),
    "roster_of_catalog": (lambda v: federation.roster_of_catalog(v.fx_roster.withColumn("fed_id", F.lit("f")), "EUROPE"), "select 'f' as fed_id, name, joined_at_s, status from @fx_roster where observer = 'EUROPE'"),
    "roster_of_snapshot": (lambda v: federation.roster_of_snapshot(v.fx_generation), "select name, node, status, cast(null as bigint) as joined_at_s from @fx_generation where generation = 0"),
    "snapshot_pair": (lambda v: federation.snapshot_pair(v.fx_generation), "select name, cast(max(case when generation = 0 then file_count end) as bigint) as current, cast(max(case when generation = 1 then file_count end) as bigint) as previous from @fx_generation where generation < 2 group by name"),
    "snapshot_rotate": (lambda v: _long(federation.rotate(v.fx_generation.select("name", "generation", "file_count"), v.fx_generation.where("generation = 0").select("name", (F.col("file_count") + 100).alias("file_count"))), "generation", "file_count"), "select name, cast(0 as bigint) as generation, cast(file_count + 100 as bigint) as file_count from @fx_generation where generation = 0 union all select name, cast(1 as bigint), cast(file_count as bigint) from @fx_generation where generation = 0"),
    "snapshot_of_listing": (
        lambda v: federation.snapshot_of(v.fx_catalog, v.fx_members, 7).select("name", "file_count", F.sha2(F.array_join("ids", ","), 256).alias("ids")),
        "select name, count(c.id) as file_count, sha(coalesce(string_agg(c.id, ',' order by c.id), '')) as ids from @fx_members m left join @fx_catalog c on c.member = m.name where status = 'active' and answered group by name",
    ),
    "listing_live_or_cached": (
        lambda v: federation.live_or_cached(v.fx_catalog, v.fx_members, v.fx_members.select("name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(0))).alias("generation")).where("generation > 0").withColumn("ids", F.array(F.lit("a"), F.lit("b")))),
        "select member, id, path, false as cached from @fx_catalog where member in (select name from @fx_members where status = 'active' and answered) union all select name, id, null, true from @fx_members, (values ('a'), ('b')) x(id) where status = 'active' and not answered",
    ),
    "member_is_active": (lambda v: federation.has_active(v.fx_node, v.nation.select("n_name").union(v.region.select("r_name")).toDF("name")), "select x.name, n.name is not null as active from (select n_name as name from @nation union all select r_name from @region) x left join @fx_node n on n.name = x.name and n.status = 'active'"),
    "member_node": (lambda v: federation.node_of(v.fx_node, v.nation.select("n_name").union(v.region.select("r_name")).toDF("name")), "select x.name, coalesce(n.node, '') as node from (select n_name as name from @nation union all select r_name from @region) x left join @fx_node n on n.name = x.name"),
    "pending_roster_ops": (
        lambda v: federation.pending_roster_ops(v.fx_wal.withColumn("op_type", F.when(F.col("op_type") == "move", "roster").otherwise(F.col("op_type"))), v.fx_members),
        "select name, case when answered then (select count(*) from @fx_wal w where w.member = name and op_type = 'move' and state = 'intent') else 0 end as n from @fx_members",
    ),
    "source_resolution": (
        lambda v: federation.source(v.fx_catalog.select("member", "path", "id"), v.fx_members, v.fx_catalog.select(F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "member", "path")).when(F.col("doc_id") % 3 == 1, F.substring("id", 1, 20)).otherwise(F.concat(F.lit("node-9/"), "path")).alias("arg")).union(v.nation.select("n_name")), v.fx_catalog.select("member", "id"), v.fx_moves.limit(0)).select("arg", "verdict", "member"),
        """with a as (select case when doc_id % 3 = 0 then member || '/' || path when doc_id % 3 = 1 then substr(id, 1, 20) else 'node-9/' || path end as arg, doc_id % 3 as k, member, id from @fx_catalog), up as (select name from @fx_members where answered and status = 'active')
         select arg, case when k = 2 then 'not-found' when k = 1 and not exists (select 1 from up where name = a.member) then 'partial-view' when not exists (select 1 from up where name = a.member) then 'partial-view' else case when k = 0 then 'found-at-home' else 'found-elsewhere' end end as verdict, case when k < 2 and exists (select 1 from up where name = a.member) then member end as member from a
         union all select n_name, 'not-found', null from @nation""",
    ),
    "pull_sources": (
        lambda v: federation.resolve_entries(v.fx_lock_id, _moves_state(v), v.fx_members),
        f"with recursive {RESOLVE} select path, case when l.id = '' then location else res.member end as member, case when l.id <> '' and res.member is null then 'unresolved-' || coalesce(res.outcome, 'unknown') when m.status <> 'active' then 'home-' || m.status when l.id <> '' and res.member <> location then 'moved' end as warning from @fx_lock_id l left join res on res.id = l.id left join @fx_members m on m.name = l.location",
    ),
    "pull_run": (
        lambda v: _long(pipelines.pull(v.fx_tree, v.fx_lock_id, _moves_state(v), v.fx_members, v.fx_objects).select("path", "verdict", "member", "exit_code"), "exit_code"),
        f"""with recursive {RESOLVE}, e as (select l.path, case when l.id = '' then location else res.member end as member, case when l.id <> '' and res.member is null then coalesce(res.outcome, 'unknown') end as why, t.path is not null as have, o.object_key, o.observed_sha, l.sha256 from @fx_lock_id l left join res on res.id = l.id left join @fx_tree t on t.path = l.path and t.sha256 = l.sha256 left join @fx_objects o on o.object_key = l.sha256 where not l.deleted),
         w as (select *, case when have then 'current' when member is null then 'unresolved' when object_key is null then 'no-bytes' when observed_sha <> sha256 then 'corrupt' else 'fetched' end as verdict from e)
         select path, verdict, case when not have then member end as member, cast(case when verdict in ('current', 'fetched') then 0 when verdict = 'unresolved' and why <> 'missing' then 6 else 5 end as bigint) as exit_code from w""",
    ),
    "roster_fan_out": (lambda v: federation.fan_out(v.fx_node), "select name, case when not answered then 'pending' when (select bool_or(answered and not permitted) from @fx_node) then 'refused' else 'applied' end as result from @fx_node"),
    "roster_write": (
        lambda v: pipelines.write_roster(v.fx_roster.select("observer", F.lit("f").alias("fed_id"), "name", F.lit("n").alias("node"), "joined_at_s", "status"), v.region.where("r_regionkey > 1").select(F.col("r_name").alias("observer")), v.fx_node, v.region.where("r_regionkey < 4").select(F.col("r_name").alias("member")), _log(v).where("seq < 0"), "f", "join", "x").table.select("observer", "name", "status"),
        "select observer, name, status from @fx_roster where observer not in (select r_name from @region where r_regionkey in (2, 3)) union all select r_name, name, status from @region, @fx_node where r_regionkey in (2, 3)",
    ),
    "roster_join": (lambda v: pipelines.join_federation(v.fx_node.select("name", "node", "joined_at_s", "status"), "newcomer", "new", 9), "select name, node, joined_at_s, status from @fx_node union all select 'newcomer', 'new', 9, 'active'"),
    "federation_id": (
        lambda v: v.fx_node.select("name", pipelines.federation_id(F.col("name"), F.col("node"), F.lit("me"), F.lit("2024-01-01T00:00:00Z")).alias("fed_id")),
        """select name, sha('seq = 0' || chr(10) || 'op_id = "' || substr(h,1,12) || '4' || substr(h,14,3) || translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr(h,18,15) || '"' || chr(10) || 'prev_hash = "' || repeat('0', 64) || '"' || chr(10) || 'op_type = "roster"' || chr(10) || 'blob_refs = []' || chr(10) || 'actor = "me"' || chr(10) || 'created_at = 2024-01-01T00:00:00Z' || chr(10) || chr(10) || '[args]' || chr(10) || 'action = "init"' || chr(10) || 'member = "' || name || '"' || chr(10) || 'node = "' || node || '"' || chr(10)) as fed_id
         from (select name, node, sha('fed-roster' || chr(0) || '' || chr(0) || 'init' || chr(0) || name) as h from @fx_node) x""",
    ),
    "gc_sweep_journaled": (
        lambda v: _swept(v).report.select("object_key", "verdict"),
        f"with {SWEPT} select object_key, case when busy then 'skipped-pending' else 'deleted' end as verdict from doom",
    ),
    "gc_sweep_catalog": (lambda v: _swept(v).table.select("member", "path"), f"with {SWEPT} select member, path from @fx_catalog where sha256 not in (select object_key from doom where not busy)"),
    "gc_sweep_intents": (
        lambda v: _swept(v).intents.select("member", "op_id", F.size("blob_refs").cast("long").alias("n"), "verdict"),
        f"""with {SWEPT}, h as (select git.member, git.id, sha('gc' || chr(0) || 'run' || chr(0) || git.member || chr(0) || substr(git.id, 1, 2)) as h from doom join git on git.sha256 = doom.object_key where not busy)
         select member, substr(h,1,12) || '4' || substr(h,14,3) || translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr(h,18,15) as op_id, count(*) as n, 'appended' as verdict from h group by member, h""",
    ),
    "gc_retry": (
        lambda v: pipelines.gc_retry(v.fx_pending.select(F.array("id", F.lit("gone")).alias("blob_refs")), v.fx_catalog).report,
        "select distinct sha256 as object_key from @fx_catalog where id in (select id from @fx_pending)",
    ),
    "move_across_report": (
        lambda v: pipelines.move_across(v.fx_catalog, v.fx_move, v.fx_objects, _log(v).where("seq < 0")).report.select("member", "path", "verdict"),
        f"with {MOVED} select member, path, verdict from j",
    ),
    "move_across_table": (
        lambda v: pipelines.move_across(v.fx_catalog, v.fx_move, v.fx_objects, _log(v).where("seq < 0")).table.select("member", "path", "id", "sha256"),
        f"with {MOVED} select coalesce(j.to_member, c.member) as member, coalesce(j.to_path, c.path) as path, c.id, coalesce(j.observed_sha, c.sha256) as sha256 from @fx_catalog c left join (select * from j where verdict in ('moved', 'rehomed')) j on c.member = j.member and c.path = j.path",
    ),
    "scan_apply_report": (lambda v: _scanned(v).report, f"with {SCANNED} select path, kind, verdict from done"),
    "scan_apply_table": (
        lambda v: _scanned(v).table.select("path", "sha256", "size", "last_scanned_s"),
        f"""with {SCANNED}, ok as (select * from done where verdict = 'applied'), c as (select c.path as was, coalesce(ok.path, c.path) as path, coalesce(ok.sha256, c.sha256) as sha256, c.size, c.last_scanned_s, ok.kind from @fx_catalog_1 c left join ok on coalesce(ok.old_path, ok.path) = c.path and ok.kind <> 'added')
         select c.path, c.sha256, case when c.kind is null then c.size else d.size end as size, case when c.kind is null then c.last_scanned_s else 1800000000 end as last_scanned_s from c left join @fx_disk_1 d on d.path = c.path where c.kind is null or c.kind <> 'deleted'
         union all select ok.path, ok.sha256, d.size, 1800000000 from ok join @fx_disk_1 d on d.path = ok.path where ok.kind = 'added'""",
    ),
    "bootstrap_resume": (
        lambda v: pipelines.bootstrap(v.fx_disk, "node-1", v.fx_ingested.select(identity.op_id(F.lit("ingest"), F.lit("node-1"), "path", "sha256").alias("op_id"), "state", "doc_id")).select("path", "action"),
        "select path, case when doc_id % 2 > 0 then 'new' when doc_id % 3 = 0 then 'done' else 'resume' end as action from @fx_disk",
    ),
    "vault_init": (
        lambda v: pipelines.init_vault(v.fx_disk.select("path", (~globs.ignored(F.col("path"), globs.parse_ignore("new/\n*.tmp"))).alias("kept")), v.fx_disk.select("path", "sha256", "size"), "node-1", v.fx_log).select("path", "action"),
        r"select path, 'new' as action from @fx_disk where not starts_with(path, 'new/') and not regexp_matches(path, '^(.*/)?[^/]*\.tmp$')",
    ),
    "repo_track": (
        lambda v: pipelines.repo_track(["**/*.pdf"], ["**/*.stl", "src1/**", "**/*.pdf"], v.fx_tree)[1],
        rf"select path from @fx_tree where regexp_matches(path, '{RX_IN}') or regexp_matches(path, '{RX_OV[0]}')",
    ),
    "track_in_order": (
        lambda v: pipelines.track(v.fx_tree.select("path", F.col("doc_id").alias("position")), v.fx_catalog_tracked, v.fx_disk),
        "with j as (select t.path, t.doc_id, case when d.path is null then 'missing' when c.path is null then 'tracked' when c.sha256 = d.sha256 then 'already' else 'drifted' end as verdict from @fx_tree t left join @fx_catalog_tracked c on t.path = c.path left join @fx_disk d on t.path = d.path) select path, case when doc_id > (select min(doc_id) from j where verdict = 'missing') then 'not-reached' else verdict end as verdict from j",
    ),
    "sync_mode_rehome": (
        lambda v: pipelines.set_sync_mode(v.fx_catalog, v.fx_lock.select("path", F.when(F.col("doc_id") % 4 == 0, "manual").otherwise("git").alias("to_mode")), objects=v.fx_objects).report,
        "select l.path, l.to_mode, case when c.path is null then 'no-file' when c.sync_mode = l.to_mode then 'same' when l.to_mode = 'manual' then 'changed' when o.object_key is null then 'no-bytes' when o.observed_sha <> c.sha256 then 'rehomed' else 'changed' end as verdict, case when l.to_mode = 'git' and c.sync_mode <> 'git' and o.observed_sha <> c.sha256 then o.observed_sha end as new_sha256 from (select path, case when doc_id % 4 = 0 then 'manual' else 'git' end as to_mode from @fx_lock) l left join @fx_catalog c on l.path = c.path left join @fx_objects o on o.object_key = c.sha256",
    ),
    "put_copy": (
        lambda v: _long(pipelines.put(v.fx_catalog.select("member", "path", "id"), v.fx_upload.select("member", "path", "id"), "copy").report, "rank"),
        f"""with {UP}, x as (select *, rank - case when there then 0 else 1 end as k, regexp_replace(path, '\\.[^./]*$', '') as stem, regexp_extract(path, '\\.[^./]*$') as ext from up)
         select path, rank, case when not there and rank = 1 then path else stem || ' (' || (k + 1) || ')' || ext end as final_path, case when not there and rank = 1 then 'put' else 'copied' end as verdict from x""",
    ),
    "put_rename": (
        lambda v: _long(pipelines.put(v.fx_catalog.select("member", "path", "id"), v.fx_upload.select("member", "path", "id", "rename_to"), "rename").report, "rank"),
        f"""with {UP}, x as (select *, not there and rank = 1 as free from up), y as (select *, case when not free and rename_to <> '' then row_number() over (partition by rename_to order by free, path, rank) end as turn from x),
         z as (select *, case when free then 'put' when rename_to = '' then 'needs-name' when turn > 1 or rename_to in (select path from @fx_catalog union select path from @fx_upload) then 'refused' else 'renamed' end as verdict from y)
         select path, rank, case verdict when 'put' then path when 'renamed' then rename_to end as final_path, verdict from z""",
    ),
    "verify_all": (
        lambda v: _long(pipelines.verify(v.fx_lock, v.fx_lock_version, v.fx_objects, scan.three_way(_lock_ids(v), v.fx_catalog, v.fx_disk, v.fx_pending, _certified())), "exit_code"),
        f"with {THREE} select (select count(*) from @fx_objects where object_key <> observed_sha) as n_corrupt, (select count(distinct sha256) from (select sha256 from @fx_lock union select sha256 from @fx_lock_version) k where sha256 not in (select object_key from @fx_objects)) as n_missing, count(*) as n_findings, cast(5 as bigint) as exit_code from three",
    ),
    "vault_stat": (
        lambda v: pipelines.stat(v.fx_catalog, v.fx_catalog.select("id", F.lit("found-at-home").alias("outcome"), F.when(F.col("doc_id") % 5 == 0, "nowhere").otherwise(F.col("member")).alias("member")), v.fx_objects).select("id", "member", "path", "freshness"),
        "select c.id, case when doc_id % 5 = 0 then 'nowhere' else member end as member, case when doc_id % 5 > 0 then path end as path, case when doc_id % 5 = 0 or o.object_key is null then 'unknown' when o.observed_sha = c.sha256 then 'fresh' else 'drifted' end as freshness from @fx_catalog c left join @fx_objects o on o.object_key = c.sha256",
    ),
    "scan_confirmed": (
        lambda v: pipelines.absorb_scan(v.fx_catalog, v.fx_disk, v.fx_confirmed).report.select("path", "kind"),
        f"with {DIFF} select path, kind from changes where kind <> 'deleted' or path in (select path from @fx_confirmed)",
    ),
    "catalog_upsert": (
        lambda v: projection.remove(projection.upsert(v.fx_catalog.select("member", "path", "sha256"), v.fx_upload.select("member", "path", F.lit("new").alias("sha256")).distinct()), v.fx_pending.join(v.fx_catalog.select("id", "path"), "id").select("member", "path")),
        "select * from (select member, path, sha256 from @fx_catalog c where not exists (select 1 from @fx_upload u where u.member = c.member and u.path = c.path) union all select distinct member, path, 'new' from @fx_upload) x where not exists (select 1 from @fx_catalog c where c.member = x.member and c.path = x.path and c.doc_id % 13 = 0)",
    ),
    "header_recovery": (
        lambda v: pipelines.header(v.region.select(F.lit("").alias("fed_id")), v.region.select(F.lit("f").alias("fed_id")), True),
        "select 'f' as fed_id, 'peers' as source",
    ),
    "reserved_keys": (
        lambda v: v.fx_tree.select("path", globs.reserved(F.concat(F.when(F.col("doc_id") % 3 == 0, "meta/").when(F.col("doc_id") % 3 == 1, "objects").otherwise(""), F.col("path"))).alias("reserved"), globs.has_meta(F.concat("path", F.when(F.col("doc_id") % 2 == 0, "*").otherwise(""))).alias("glob")),
        "select path, doc_id % 3 = 0 as reserved, doc_id % 2 = 0 as glob from @fx_tree",
    ),
    "store_keys": (
        lambda v: v.fx_tree.select("path", scalars.short(F.col("sha256")).alias("short"), scalars.is_hex64(F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).otherwise(F.upper("sha256"))).alias("hex"), scalars.entry_name(F.col("doc_id")).alias("entry"), scalars.seq_of_marker(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.when(F.col("doc_id") % 3 == 0, ".done").otherwise(".failed")), "done").alias("seq"), scalars.freshness(F.col("sha256"), F.when(F.col("doc_id") % 5 == 0, F.col("sha256")).otherwise("x")).alias("freshness"), scalars.sync_mode(F.when(F.col("doc_id") % 2 == 0, "").otherwise("git")).alias("mode")),
        "select path, substr(sha256, 1, 12) as short, doc_id % 2 = 0 or sha256 = upper(sha256) and false as hex, lpad(cast(doc_id as varchar), 12, '0') || '.toml' as entry, case when doc_id % 3 = 0 then doc_id end as seq, case when doc_id % 5 = 0 then 'verified' else 'changed-since-scan' end as freshness, case when doc_id % 2 = 0 then 'manual' else 'git' end as mode from @fx_tree",
    ),
    "checksum_lines": (
        lambda v: v.fx_tree.select("path", scalars.digest_of(F.concat(F.lit("  "), "sha256", F.lit("  x"))).alias("digest"), scalars.checksum_for(F.concat(F.lit("junk\n"), "sha256", F.lit(" *"), F.lit("f.bin\n")), F.lit("f.bin")).alias("of_name"), F.array_join(scalars.split_lines(F.concat(F.lit(" a \n\n"), "sha256", F.lit("\n"))), "|").alias("lines")),
        "select path, sha256 as digest, sha256 as of_name, 'a|' || sha256 as lines from @fx_tree",
    ),
    "error_exit_codes": (
        lambda v: _long(v.part.select("p_partkey", scalars.exit_of(F.get(F.array(*[F.lit(k).cast("string") for k in [*scalars.EXIT_CODES, None, "odd"]]), (F.col("p_partkey") % 13).cast("int"))).alias("code")), "code"),
        f"select p_partkey, cast({[*scalars.EXIT_CODES.values(), 0, 1]}[1 + p_partkey % 13] as bigint) as code from @part",
    ),
    "time_text": (
        lambda v: v.fx_wal.select("op_id", scalars.rfc3339(F.when(F.col("seq") % 3 > 0, F.col("created_at"))).alias("text")),
        "select op_id, case when seq % 3 > 0 then strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') else '' end as text from @fx_wal",
    ),
    "answers": (
        lambda v: v.part.select("p_partkey", *[f(F.get(F.array(*map(F.lit, [" C", "copy", "R ", "rename", "s", "", "Yes", "y", "no"])), (F.col("p_partkey") % 9).cast("int"))).alias(n) for n, f in (("mode", scalars.conflict_mode), ("yes", scalars.is_yes))]),
        "select p_partkey, case when p_partkey % 9 < 2 then 'copy' when p_partkey % 9 < 4 then 'rename' else 'stop' end as mode, p_partkey % 9 in (6, 7) as yes from @part",
    ),
    "status_words": (
        lambda v: v.fx_node.select("name", scalars.status_verb(F.col("status")).alias("verb"), scalars.member_names(F.when(F.col("answered"), F.array("name", "node")).otherwise(F.array().cast("array<string>"))).alias("names")),
        "select name, case status when 'evicted' then 'was evicted from' when 'left' then 'left' else 'is no longer active in' end as verb, case when answered then name || ', ' || node else 'an unknown member' end as names from @fx_node",
    ),
    "who_acts": (
        lambda v: v.part.select("p_partkey", *[f(F.get(F.array(F.lit("net"), F.lit("@"), F.lit("")), (F.col("p_partkey") % 3).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "e@x").otherwise("")).alias(n) for n, f in (("pusher", scalars.pusher), ("actor", scalars.actor))]),
        "select p_partkey, case when p_partkey % 3 = 0 then 'net' when p_partkey % 2 = 0 then concat('e', chr(64), 'x') else 'unknown' end as pusher, case when p_partkey % 3 = 0 then 'net' when p_partkey % 3 = 1 then chr(64) when p_partkey % 2 = 0 then concat('e', chr(64), 'x') else 'unknown' end as actor from @part",
    ),
    "appended_lines": (
        lambda v: v.fx_tree.select("path", scalars.with_lines(F.concat(F.lit("one\n"), "path"), F.array(F.lit(" one "), F.lit("two"), F.col("path"))).alias("text"), F.array_join(scalars.with_include(F.array("path"), F.when(F.col("doc_id") % 2 == 0, F.col("path")).otherwise("**")), ",").alias("include")),
        "select path, 'one' || chr(10) || path || chr(10) || 'two' || chr(10) as text, case when doc_id % 2 = 0 then path else path || ',**' end as include from @fx_tree",
    ),
    "track_modes": (
        lambda v: v.fx_tree.select("path", scalars.track_mode(F.array("path"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 > 1, F.col("doc_id") % 7 == 0).alias("mode")),
        "select path, case when doc_id % 6 = 0 then 'both-flags' when doc_id % 2 = 0 then 'vault' when doc_id % 3 = 0 or doc_id % 5 <= 1 then 'repo' when doc_id % 7 = 0 then 'ambiguous' else 'vault' end as mode from @fx_tree",
    ),
    "guarded_ids": (
        lambda v: v.fx_catalog.select("path", identity.guarded_id({**{k: F.col(k) for k in identity.GENESIS}, "origin_node": F.when(F.col("doc_id") % 4 > 0, F.col("origin_node"))}).alias("g")).select("path", "g.*"),
        f"select path, case when doc_id % 4 > 0 then {GENESIS_SHA} end as id, case when doc_id % 4 = 0 then 'origin_node' end as problem from @fx_catalog",
    ),
    "lock_document": (
        lambda v: sinks.lock_text(_lock_v(v, "fx_lock").withColumn("id", F.lit("i")).withColumn("pusher", F.lit("me"))).select("path", F.sha2("text", 256).alias("sha256")),
        """select path, sha('[[entry]]' || chr(10) || 'path = "' || path || '"' || chr(10) || 'id = "i"' || chr(10) || 'sha256 = "' || sha256 || '"' || chr(10) || 'size = ' || size || chr(10) || 'location = "' || location || '"' || chr(10) || 'pusher = "me"' || chr(10) || 'history = ' || history || chr(10) || 'preserve = ' || preserve || chr(10) || case when deleted then 'deleted = true' || chr(10) else '' end || case when history then 'versions = ["' || sha256 || '", "' || sha(path || '#v1') || '"]' || chr(10) else '' end) as sha256 from @fx_lock""",
    ),
    "catalog_document": (
        lambda v: sinks.catalog_text(v.fx_catalog.select("member", "path", "id", F.struct(*identity.GENESIS).alias("genesis"), "sha256", "sync_mode", "size", F.timestamp_seconds("last_scanned_s").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("timestamp").alias("last_scanned"))).select("path", F.sha2("text", 256).alias("sha256")),
        """select path, sha('[[file]]' || chr(10) || 'id = "' || id || '"' || chr(10) || 'genesis = {content_sha256 = "' || content_sha256 || '", original_path = "' || original_path || '", ingest_op_id = "' || ingest_op_id || '", origin_node = "' || origin_node || '"}' || chr(10) || 'sha256 = "' || sha256 || '"' || chr(10) || 'path = "' || path || '"' || chr(10) || 'sync_mode = "' || sync_mode || '"' || chr(10) || 'size = ' || size || chr(10) || 'created_at = ' || strftime(make_timestamp(last_scanned_s * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10)) as sha256 from @fx_catalog""",
    ),
    "refs_written": (
        lambda v: sinks.refs_text(sinks.refs_table(v.fx_lock_version.select(F.col("path").alias("path_id"), "pos", "sha256"), v.fx_lock.where("preserve").select(F.col("path").alias("path_id"), F.array("sha256").alias("versions")))).select("path_id", F.sha2("text", 256).alias("sha256")),
        "select path as path_id, sha(string_agg(sha256 || chr(10), '' order by pos)) as sha256 from (select path, pos, sha256 from @fx_lock_version where path not in (select path from @fx_lock where preserve) union all select path, 0, sha256 from @fx_lock where preserve) x group by path",
    ),
    "keys_put_over": (
        lambda v: sinks.delete_keys(sinks.put_over(v.fx_lock.select(F.col("path").alias("key"), "sha256"), v.fx_tree.select(F.col("path").alias("key"), "sha256")), v.fx_pending.join(v.fx_catalog.select("id", F.col("path").alias("key")), "id").select("key")),
        "select * from (select path as key, sha256 from @fx_lock where path not in (select path from @fx_tree) union all select path, sha256 from @fx_tree) x where key not in (select path from @fx_catalog where doc_id % 13 = 0)",
    ),
    "receipts_certified": (
        lambda v: sinks.receipts_table(v.fx_catalog.select("id", F.struct(*identity.GENESIS).alias("genesis"), F.lit("old").alias("path")), v.fx_catalog_seen.select("id", F.struct(*identity.GENESIS).alias("genesis"), "path")).select("id", "path"),
        f"select id, case when doc_id % 2 = 0 and id = {GENESIS_SHA} then path else 'old' end as path from @fx_catalog",
    ),
    "registry_document": (
        lambda v: sinks.locations_text(v.supplier.select(F.col("s_name").alias("name"), *[F.expr(x) for x in LOCATION])),
        f"""select name, '[locations."' || name || '"]' || chr(10) || {' || '.join(f"case when coalesce({c}, '') <> '' then '{n} = ' || chr(34) || {c} || chr(34) || chr(10) else '' end" for n, c in (("node", "node"), ("base_path", "base_path"), ("user", '"user"'), ("share", "share"), ("backend", "backend")))} as text from (select s_name as name, {', '.join(LOCATION).replace('as user', 'as "user"')} from @supplier) y""",
    ),
    "rows_as_json": (lambda v: sinks.to_json_rows(v.fx_node.select("name", "joined_at_s", "answered")), """select '{"name":"' || name || '","joined_at_s":' || joined_at_s || ',"answered":' || answered || '}' as value from @fx_node"""),
    "rows_as_table": (
        lambda v: sinks.aligned(v.fx_node.select("name", "joined_at_s"), "name"),
        "select rtrim(rpad(a, (select greatest(4, max(length(name)))::int from @fx_node), ' ') || '  ' || rpad(b, 11, ' ')) as text from (select 'NAME' as a, 'JOINED_AT_S' as b union all select name, cast(joined_at_s as varchar) from @fx_node) x",
    ),
}


def _query(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Views(spark, sf_dir))


QUERIES = {k: _query(build) for k, (build, _) in CATALOG.items()}
ORACLES = {k: duck(sql) for k, (_, sql) in CATALOG.items() if sql}
