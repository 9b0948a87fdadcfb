"""Catalog-shaped views over the driver's tables, in Spark and, as common table expressions, in DuckDB.

In a template @name is a table or view, sha(e) the hex SHA-256 of a string, bytes(e) its length in UTF-8 and json_k(e) the number under k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents".split()
_PATH = "concat(source,'/',lang,'/',cast(doc_id as string), case doc_id % 4 when 0 then '.pdf' when 1 then '.stl' when 2 then '.tmp' else '.md' end)"

VIEWS = {
    "fx_tree": f"select {_PATH} as path, sha(text) as sha256, cast(bytes(text) as bigint) as size, doc_id from @documents where doc_id % 10 <> 3",
    "fx_lock": f"""select {_PATH} as path, case when doc_id % 10 = 1 then sha(concat(text,'#old')) else sha(text) end as sha256, cast(bytes(text) as bigint) as size,
      concat('node-',cast(doc_id % 5 as string)) as location, 1704067200 + doc_id*60 as pushed_at_s, doc_id % 6 = 0 as history, doc_id % 9 = 0 as preserve, doc_id % 10 = 2 as deleted, doc_id
      from @documents where doc_id % 10 <> 0""",
    "fx_lock_version": "select path, 0 as pos, sha256 from @fx_lock where history union all select path, 1 as pos, sha(concat(path,'#v1')) as sha256 from @fx_lock where history",
    "fx_lock_theirs": """select path, case when doc_id % 3 = 0 then sha(concat(path,'#theirs')) else sha256 end as sha256, size, location,
      pushed_at_s + case when doc_id % 12 = 0 then 0 when doc_id % 2 = 0 then 30 else -30 end as pushed_at_s, history, preserve, doc_id % 4 = 2 as deleted, doc_id from @fx_lock where doc_id % 4 <> 1""",
    "fx_objects": """select sha256 as object_key, case when substr(sha256,2,1)='f' then reverse(sha256) else sha256 end as observed_sha
      from (select sha256 from @fx_lock union select sha256 from @fx_lock_version union select sha(concat(text,'#orphan')) as sha256 from @documents where doc_id % 11 = 0) u where substr(sha256,1,1) <> '0'""",
    "fx_roster": """select r_name as observer, n_name as name, 1704067200 + ((n_nationkey*7 + r_regionkey*3) % 4)*60 as joined_at_s,
      case (n_nationkey + r_regionkey) % 5 when 0 then 'left' when 1 then 'evicted' else 'active' end as status from @nation join @region on r_regionkey >= 0""",
    "fx_wal": """select concat('node-',cast(user_id % 5 as string)) as member, row_number() over (partition by user_id % 5 order by event_id) - 1 as seq, sha(concat('op',cast(event_id as string))) as op_id,
      case event_type when 'signup' then 'ingest' when 'click' then 'scan' when 'view' then 'move' when 'purchase' then 'sync_mode' else 'delete' end as op_type,
      concat('u',cast(user_id as string),'/k',cast(json_k(props) % 4 as string)) as path, sha(concat('c',cast(event_id as string))) as content_sha256,
      case event_id % 10 when 0 then 'intent' when 1 then 'failed' else 'done' end as state, ts as created_at, event_id from @events""",
    # self_hash of the raw bytes and prev_hash; every 97th entry was changed after the next one was linked
    "fx_chain": """select member, seq, sha(concat(op_id, case when seq % 97 = 50 then '!' else '' end)) as self_hash,
      coalesce(lag(sha(op_id)) over (partition by member order by seq), '0000000000000000000000000000000000000000000000000000000000000000') as prev_hash from @fx_wal where seq % 211 <> 200""",
    "fx_catalog": """select concat('node-',cast(doc_id % 5 as string)) as member, path, sha256, size, case doc_id % 3 when 0 then 'git' when 1 then 'manual' else 's3' end as sync_mode,
      sha256 as content_sha256, path as original_path, concat('op',cast(doc_id as string)) as ingest_op_id, concat('node-',cast(doc_id % 5 as string)) as origin_node,
      case when doc_id % 17 = 0 then sha(path) else sha(concat('content_sha256 = "',sha256,'"',chr(10),'original_path = "',path,'"',chr(10),'ingest_op_id = "op',cast(doc_id as string),'"',chr(10),'origin_node = "node-',cast(doc_id % 5 as string),'"',chr(10))) end as id,
      1704067200 + doc_id as last_scanned_s, doc_id from @fx_tree""",
    # the disk as found: a seventh each gone, edited, rotten, touched and renamed; and files that no catalog has
    "fx_disk": """select case when doc_id % 7 = 4 then concat(path,'.moved') else path end as path, case when doc_id % 7 in (1,2) then sha(concat(sha256,'#now')) else sha256 end as sha256,
      size + case when doc_id % 7 = 1 then 1 else 0 end as size, last_scanned_s + case when doc_id % 7 = 3 then 9 when doc_id % 7 = 2 then 0 else -9 end as mtime_s, doc_id from @fx_catalog where doc_id % 7 <> 0
      union all select concat('new/',cast(doc_id as string)) as path, sha(text) as sha256, cast(bytes(text) as bigint) as size, 1704067200 + doc_id as mtime_s, doc_id from @documents where doc_id % 10 = 3""",
    "fx_pending": "select member, id, concat('pend',cast(doc_id as string)) as op_id from @fx_catalog where doc_id % 13 = 0",
    "fx_members": "select concat('node-',cast(n_nationkey as string)) as name, case when n_nationkey = 5 then 'left' else 'active' end as status, n_nationkey <> 3 as answered from @nation where n_nationkey < 6",
    "fx_query": "select sha(concat('f',cast(doc_id as string))) as id, case when doc_id % 9 = 0 then null else concat('node-',cast((doc_id + case when doc_id % 4 = 0 then 1 else 0 end) % 5 as string)) end as home, doc_id from @documents",
    "fx_held": "select concat('node-',cast(doc_id % 5 as string)) as member, id from @fx_query where doc_id % 6 <> 0 union all select 'node-5' as member, id from @fx_query where doc_id % 24 = 12",
    # moves of files that their members no longer hold: chains to a member that left, to a member that is down, to an unknown one, in a circle, to nowhere
    "fx_moves": """select concat('node-',cast(doc_id % 3 as string)) as member, doc_id % 40 as seq, id, 'done' as state, case when doc_id % 24 = 12 then 'node-4' when doc_id % 30 = 6 then 'node-3' when doc_id % 42 = 18 then 'elsewhere' when doc_id % 66 = 24 then concat('node-',cast((doc_id + 1) % 3 as string)) else 'node-4' end as moved_to from @fx_query where doc_id % 6 = 0 and doc_id % 36 <> 0
      union all select 'node-4' as member, 1 as seq, id, 'done' as state, 'node-5' as moved_to from @fx_query where doc_id % 24 = 12
      union all select concat('node-',cast((doc_id + 1) % 3 as string)) as member, 2 as seq, id, 'done' as state, concat('node-',cast(doc_id % 3 as string)) as moved_to from @fx_query where doc_id % 66 = 24 and doc_id % 24 <> 12 and doc_id % 30 <> 6 and doc_id % 42 <> 18 and doc_id % 36 <> 0
      union all select 'node-0' as member, 99 as seq, id, 'intent' as state, 'node-1' as moved_to from @fx_query where doc_id % 36 = 0""",
    # what a branch keeps, a peer's catalog and members of it that can be read
    "fx_branch": "select * from @fx_lock where doc_id % 2 = 0",
    "fx_prune": "select member, seq, self_hash as hash from @fx_chain where seq % 100 = 7",
    "fx_query_moved": "select * from @fx_query where doc_id % 6 = 0",
    "fx_catalog_tracked": "select * from @fx_catalog where doc_id % 4 > 0",
    "fx_move": "select concat('node-', cast(doc_id % 5 as string)) as member, path, 'node-0' as to_member, case when doc_id % 4 = 1 then 'taken/once' else concat('to/', path) end as to_path from @fx_lock where doc_id % 6 = 1",
    "fx_known": "select concat('node-', cast(doc_id % 5 as string)) as name, doc_id % 3 as generation, id from @fx_query where doc_id % 4 < 2",
    # starts of ids of 2 to 8 characters, and one that no id has
    "fx_prefix": "select distinct substr(id, 1, cast(2 + doc_id % 7 as int)) as prefix from @fx_catalog union select 'zz' as prefix from @region",
    # what a half-done ingest has journaled, what a user has confirmed, and receipts that come anew
    "fx_ingested": "select path, sha256, case when doc_id % 3 = 0 then 'done' else 'intent' end as state, doc_id from @fx_disk where doc_id % 2 = 0",
    "fx_confirmed": "select path from @fx_tree where doc_id % 2 = 0",
    "fx_catalog_seen": "select * from @fx_catalog where doc_id % 2 = 0",
    # the names that a registry has, markers beside the log, what a user removes, what comes back from receipts, and texts whose bytes are stored
    "fx_registry": "select n_name as name from @nation where n_nationkey % 3 > 0",
    "fx_marker": "select member, seq, case when seq % 4 = 0 then 'done' else 'failed' end as mark from @fx_wal where seq % 3 > 0 union all select member, seq, 'done' as mark from @fx_wal where seq % 5 = 0",
    "fx_removed": "select concat('node-',cast(doc_id % 5 as string)) as member, path from @fx_tree where doc_id % 4 = 1 union select 'node-1' as member, 'nowhere' as path from @region",
    "fx_catalog_back": "select * from @fx_catalog where doc_id % 3 = 1",
    "fx_stored": "select sha(text) as object_key, min(case when doc_id % 7 = 0 then 'rot' else text end) as content from @documents where doc_id % 3 > 0 group by sha(text)",
    "fx_wanted_id": "select id, doc_id from @fx_query where doc_id % 2 = 0",
    # a log whose chain holds, its newer half, and what writers would add to it: ids that it has, ids that repeat, refs of its open operations and refs that repeat
    "fx_log": "select member, seq, op_id, op_type, path, concat('t', op_type, cast(seq % 50 as string)) as ref2, state, created_at, sha(op_id) as self_hash, coalesce(lag(sha(op_id)) over (partition by member order by seq), '0000000000000000000000000000000000000000000000000000000000000000') as prev_hash from @fx_wal",
    "fx_log_anchor": "select member, seq, self_hash as hash from @fx_log where seq = 20",
    "fx_candidate": """select concat('node-', cast(c_custkey % 5 as string)) as member, c_custkey as position, case when c_custkey % 11 = 0 then sha(concat('op', cast(c_custkey as string))) else sha(concat('cand', cast(c_custkey % 100 as string))) end as op_id,
      concat('u', cast(c_custkey % 5 + 5 * (c_custkey % 13) as string), '/k', cast(c_custkey % 4 as string)) as ref1, concat('v', cast(c_custkey % 70 as string)) as ref2 from @customer""",
    "fx_node": "select n_name as name, concat('host-', cast(n_nationkey as string)) as node, 1704067200 + n_nationkey as joined_at_s, case n_nationkey % 4 when 1 then 'left' when 2 then 'evicted' else 'active' end as status, n_nationkey % 5 <> 2 as answered, n_nationkey % 7 <> 3 as permitted from @nation",
    "fx_generation": "select s_name as name, concat('h', cast(s_suppkey % 9 as string)) as node, case when s_suppkey % 3 = 0 then 'left' else 'active' end as status, g as generation, s_suppkey * 3 + g as file_count from @supplier join (select 0 as g union all select 1 as g union all select 2 as g) x on (s_suppkey + g) % 4 > 0",
    "fx_lock_id": """select l.path, case when l.doc_id % 7 = 0 then '' else q.id end as id, l.sha256, l.location, l.deleted, l.doc_id from @fx_lock l join @fx_query q on l.doc_id = q.doc_id""",
    "fx_upload": "select concat('node-', cast(doc_id % 5 as string)) as member, case when doc_id % 3 = 0 then path else concat('up/f', cast(doc_id % 30 as string), '.x') end as path, concat('up', cast(doc_id as string)) as id, case when doc_id % 4 = 0 then '' else concat('re/', cast(doc_id % 50 as string)) end as rename_to, doc_id from @fx_tree where doc_id % 5 = 1",
    "fx_catalog_1": "select * from @fx_catalog where member = 'node-1'",
    "fx_log_1": "select 'node-1' as member, rn - 1 as seq, concat('held', cast(rn as string)) as op_id, id as ref, sha(concat('held', cast(rn as string))) as self_hash, case when rn = 1 then '0000000000000000000000000000000000000000000000000000000000000000' else sha(concat('held', cast(rn - 1 as string))) end as prev_hash, 'intent' as state from (select id, row_number() over (order by path) as rn from @fx_catalog_1 where doc_id % 3 = 0) x",
    "fx_disk_1": "select d.path, d.sha256, d.size, d.mtime_s from @fx_disk d join @documents t on d.doc_id = t.doc_id where t.doc_id % 5 = 1",
    "fx_snapshot": "select concat('node-',cast(g.n_nationkey % 6 as string)) as name, case when g.n_nationkey < 6 then 0 else 1 end as generation, 10 + g.n_nationkey as file_count from @nation g where g.n_nationkey < 12",
}
_NEEDS_ONE_SIDE = {"fx_roster": "select n.*, r.* from (select *, explode(sequence(0, 4)) as rk from @nation) n join @region r on r.r_regionkey = n.rk"}


def _calls(sql: str, name: str, write) -> str:  # noqa: ANN001
    """sql with each name(argument) rewritten."""
    at = 0
    while (at := sql.find(f"{name}(", at)) >= 0:
        if at and (sql[at - 1].isalnum() or sql[at - 1] == "_"):
            at += 1
            continue
        depth, end = 0, at + len(name)
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        inner = _calls(sql[at + len(name) + 1 : end - 1], name, write)
        new = write(inner)
        sql = sql[:at] + new + sql[end:]
        at += len(new)
    return sql


def names(sql: str) -> set[str]:
    import re

    return set(re.findall(r"@(\w+)", sql))


def duck(sql: str) -> str:
    """A template as DuckDB SQL, with the views that it needs in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in sorted(names(text)):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    def plain(text: str) -> str:
        text = _calls(text, "sha", lambda e: f"sha256({e})")
        text = _calls(text, "bytes", lambda e: f"strlen({e})")
        text = _calls(text, "json_k", lambda e: f"cast(json_extract_string({e},'$.k') as bigint)")
        return text.replace("@", "")

    need(sql)
    ctes = ", ".join(f"{n} as ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if ctes and body.lower().startswith("with recursive "):
        return f"with recursive {ctes}, {body[15:]}"
    if ctes and body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}" if ctes else body


class Views:
    """The views and tables of one directory, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.sql(VIEWS[name]) if name in VIEWS else self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]

    def sql(self, template: str) -> DataFrame:
        text = template.replace("@nation join @region on r_regionkey >= 0", f"({_NEEDS_ONE_SIDE['fx_roster']}) x")
        text = _calls(text, "sha", lambda e: f"sha2({e},256)")
        text = _calls(text, "bytes", lambda e: f"octet_length({e})")
        text = _calls(text, "json_k", lambda e: f"cast(get_json_object({e},'$.k') as bigint)")
        used = names(text)
        for n in used:
            text = text.replace(f"@{n} ", f"{{{n}}} ").replace(f"@{n})", f"{{{n}}})")
            text = text + " " if text.endswith(f"@{n}") else text
            text = text.replace(f"@{n} ", f"{{{n}}} ")
        return self._spark.sql(text, **{n: getattr(self, n) for n in used})
