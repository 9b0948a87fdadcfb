from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratacat.operators import federation, gc, locks, lookup, projection, scan, status, wal
from stratacat.plans import pipelines

LOCK = "path string, sha256 string, size long, location string, pushed_at_s long, history boolean, preserve boolean, deleted boolean"


def lock(spark, rows):
    return spark.createDataFrame([(p, s, 1, "n", 0, False, pr, d) for p, s, pr, d in rows], LOCK)


def test_status(spark):
    tree = spark.createDataFrame([("new", "aaaa"), ("a", "bbbb"), ("edited", "cccc"), ("renamed", "dddd"), ("back", "x")], "path string, sha256 string")
    lk = lock(spark, [("a", "bbbb", False, False), ("edited", "9999", False, False), ("gone", "eeee", False, False), ("old", "dddd", False, False), ("dead", "q", False, True), ("back", "y", False, True)])
    got = {r.path: r.state for r in status.classify(tree, lk).collect()}
    assert got == {"new": "local-only", "a": "pushed", "edited": "drifted", "renamed": "local-only", "gone": "orphaned", "old": "orphaned", "back": "local-only"}


def test_renames_pair_in_order(spark):
    tree = spark.createDataFrame([("n3", "s"), ("n1", "s"), ("n2", "s")], "path string, sha256 string")
    lk = lock(spark, [("o2", "s", False, False), ("o1", "s", False, False)])
    assert {(r.old_path, r.new_path) for r in status.renames(tree, lk).collect()} == {("o1", "n1"), ("o2", "n2")}


@pytest.mark.parametrize("turn", [False, True])
def test_lock_merge(spark, turn):
    kind = "path string, sha256 string, pushed_at_s long, deleted boolean, versions array<string>"
    a = spark.createDataFrame([("p", "X", 10, False, ["Sx", "X"]), ("t", "X", 5, False, None), ("s", "Z", 1, True, None), ("only", "O", 1, False, None)], kind)
    b = spark.createDataFrame([("p", "Y", 12, False, ["Sy", "Y"]), ("t", "Y", 5, False, None), ("s", "Z", 1, False, None)], kind)
    got = {r.path: (r.sha256, r.deleted, r.versions) for r in locks.merge(*((b, a) if turn else (a, b))).collect()}
    assert got == {"p": ("Y", False, ["Sy", "Y", "Sx", "X"]), "t": ("Y", False, None), "s": ("Z", False, None), "only": ("O", False, None)}


def test_gc(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "sha256 string")
    obj = spark.createDataFrame([("A",), ("B",), ("P",)], "object_key string")
    assert {tuple(r) for r in gc.mark(obj, keys("A"), keys("P", "A")).collect()} == {("A", "kept"), ("B", "eligible"), ("P", "preserved")}
    with pytest.raises(gc.Unanswered):
        gc.gate(spark.createDataFrame([("n", "active", False)], "name string, status string, answered boolean"))


def test_chain(spark):
    rows = [("m", i, f"h{i}", f"h{i - 1}" if i else "0" * 64) for i in range(6)]
    kind = "member string, seq long, self_hash string, prev_hash string"
    assert wal.chain_breaks(spark.createDataFrame(rows, kind)).count() == 0
    bad = [("m", 2, "other", "h1") if r[1] == 2 else r for r in rows if r[1] != 4]
    assert {(r.seq, r.problem) for r in wal.chain_breaks(spark.createDataFrame(bad, kind)).collect()} == {(3, "link"), (5, "gap")}
    anchor = spark.createDataFrame([("m", 2, "h2")], "member string, seq long, hash string")
    assert wal.chain_breaks(spark.createDataFrame(rows[2:], kind), anchor).count() == 0


CAND = "member string, position long, op_id string, op_type string, blob_refs array<string>, actor string, created_at string, args map<string,string>"
CHAINED = "member string, seq long, op_id string, prev_hash string, self_hash string, blob_refs array<string>, state string"


def candidates(spark, rows):
    return spark.createDataFrame([(m, p, o, "ingest", r, "me", "2024-01-01T00:00:00Z", {"path": 'a"b'}) for m, p, o, r in rows], CAND)


def test_append_holds_the_chain(spark):
    log = spark.createDataFrame([("m", 0, "op0", "0" * 64, "h0", ["b0"], "done"), ("m", 1, "op1", "h0", "h1", ["b1"], "intent")], CHAINED)
    c = [("m", 1, "op0", ["x"]), ("m", 2, "n1", ["b1"]), ("m", 3, "n2", ["b2"]), ("m", 4, "n2", ["b3"]), ("m", 5, "n3", ["b2"]), ("m", 6, "n4", ["b4"]), ("new", 1, "k", ["b1"])]
    got = wal.append(log, candidates(spark, c))
    assert [(r.member, r.seq, r.op_id) for r in got.orderBy("member", "seq").collect()] == [("m", 2, "n2"), ("m", 3, "n4"), ("new", 0, "k")]
    whole = log.select("member", "seq", "self_hash", "prev_hash").unionByName(got.select("member", "seq", "self_hash", "prev_hash"))
    assert wal.chain_breaks(whole).count() == 0
    broken = log.withColumn("prev_hash", F.lit("no"))
    assert {(r.member, r.verdict) for r in wal.append_all(broken, candidates(spark, c)).collect()} == {("m", "chain-broken"), ("new", "appended")}
    codes = {r.verdict: r.code for r in wal.append_all(log, candidates(spark, c)).select("verdict", wal.append_exit(F.col("verdict")).alias("code")).collect()}
    assert codes == {"appended": 0, "duplicate": 0, "in-flight": 2}


def test_a_refused_candidate_bars_nobody(spark):
    log = spark.createDataFrame([("m", 0, "op0", "0" * 64, "h0", ["x"], "intent")], CHAINED)
    got = wal.append_all(log, candidates(spark, [("m", 1, "c1", ["x", "y"]), ("m", 2, "c2", ["y"]), ("m", 3, "c1", ["z"]), ("m", 4, "c3", None)])).orderBy("position").collect()
    assert [(r.op_id, r.verdict, r.seq) for r in got] == [("c1", "in-flight", None), ("c2", "appended", 1), ("c1", "appended", 2), ("c3", "appended", 3)]


def test_a_pruned_log_goes_on_after_its_anchor(spark):
    anchor = spark.createDataFrame([("m", 7, "h7")], "member string, seq long, hash string")
    none = spark.createDataFrame([], CHAINED)
    assert wal.next_slot(none, anchor).first()[:] == ("m", 8, "h7")
    r = wal.append(none, candidates(spark, [("m", 0, "o", ["r"])]), anchor).first()
    assert (r.seq, r.prev_hash) == (8, "h7")
    after = spark.createDataFrame([("m", 8, "o", "h7", "h8", [], "done"), ("m", 3, "old", "?", "?", [], "done")], CHAINED)
    assert [r.seq for r in wal.verified(after, anchor).collect()] == [8] and wal.next_slot(after, anchor).first().seq == 9


def test_append_equals_one_by_one(spark):
    rng = random.Random(5)
    rows, cands, want = [], [], {}
    for k in range(200):
        m, ops, busy, prev = f"m{k:03d}", set(), set(), "0" * 64
        for seq in range(rng.randrange(5)):
            state, refs = rng.choice(["intent", "done", "failed"]), [f"r{rng.randrange(6)}" for _ in range(rng.randrange(3))]
            rows.append((m, seq, f"op{seq}", prev, f"h{k}-{seq}", refs, state))
            prev, ops = f"h{k}-{seq}", ops | {f"op{seq}"}
            busy |= set(refs) if state == "intent" else set()
        for pos in range(rng.randrange(8)):
            op, refs = f"op{rng.randrange(12)}", [f"r{rng.randrange(6)}" for _ in range(rng.randrange(1, 3))]
            cands.append((m, pos, op, refs))
            want[m, pos] = "duplicate" if op in ops else "in-flight" if busy & set(refs) else "appended"
            if want[m, pos] == "appended":
                ops, busy = ops | {op}, busy | set(refs)
    log = spark.createDataFrame(rows, CHAINED)
    made = wal.append_all(log, candidates(spark, cands))
    assert {(r.member, r.position): r.verdict for r in made.collect()} == want and len(set(want.values())) == 3
    whole = log.select("member", "seq", "self_hash", "prev_hash").unionByName(made.where("verdict = 'appended'").select("member", "seq", "self_hash", "prev_hash"))
    assert wal.chain_breaks(whole).count() == 0


def test_waiting_by_shared_refs(spark):
    rows = [("m", 0, "a", "", "", ["x"], "intent"), ("m", 1, "b", "", "", ["y"], "done"), ("m", 2, "c", "", "", ["y", "x", "x"], "failed"), ("m", 3, "d", "", "", ["y"], "intent"), ("n", 4, "e", "", "", ["x"], "intent"), ("m", 5, "f", "", "", ["x", "y"], "intent"), ("m", 6, "g", "", "", None, "intent")]
    log = spark.createDataFrame(rows, CHAINED)
    assert {r.op_id: r.head for r in wal.waits_on_refs(log).collect()} == {"a": None, "c": "a", "d": "c", "e": None, "f": "a", "g": None}
    assert {(r.op_id, r.waits_on) for r in wal.waits_on_ops(log).collect()} == {("c", "a"), ("d", "c"), ("f", "a"), ("f", "c"), ("f", "d")}
    v = spark.createDataFrame([("m", "a", "replay"), ("m", "c", "waits"), ("m", "d", "gc")], "member string, op_id string, verdict string")
    bad = spark.createDataFrame([("m", "d", False)], "member string, op_id string, ok boolean")
    assert {r.op_id: r.result for r in wal.retry_pass(v, bad).collect()} == {"a": "done", "c": "refused", "d": "failed"}


def fold_plain(rows):
    """A list of rows, searched from the front, as a log is usually replayed."""
    files = []

    def drop(path):
        files[:] = [f for f in files if f["path"] != path]

    def put(row):
        for i, f in enumerate(files):
            if f["path"] == row["path"]:
                files[i] = row
                return
        files.append(row)

    for op, a, refs, op_id in rows:
        here = next((f for f in files if f["path"] == a.get("path")), None)
        if op == "ingest":
            g = {"content_sha256": a["content_sha256"], "original_path": a["path"], "ingest_op_id": op_id, "origin_node": "m"}
            put({"path": a["path"], "id": projection.genesis_id(g), "sha256": a["content_sha256"], "mode": "manual"})
        elif op == "scan" and here:
            put({**here, "sha256": a["new_sha256"]})
        elif op == "delete":
            drop(a["path"])
        elif op == "sync_mode" and here:
            put({**here, "mode": a["to_mode"]})
        elif op == "gc":
            for i in refs:
                drop(next((f["path"] for f in files if f["id"] == i), None))
        elif op == "move":
            f = next((f for f in files if refs and f["id"] == refs[0]), None) or next((f for f in files if f["path"] == a["from"]), None)
            if f and f["path"] != a["to"]:
                drop(f["path"])
                put({**f, "path": a["to"]})
    return {(f["path"], f["id"], f["sha256"], f["mode"]) for f in files}


def random_log(rng, n):
    ids, out = [], []
    for i in range(n):
        p, q = f"p{rng.randrange(6)}", f"p{rng.randrange(6)}"
        op = rng.choice(["ingest", "ingest", "scan", "delete", "move", "move", "sync_mode", "gc", "roster"])
        a = {"ingest": {"path": p, "content_sha256": f"c{i}"}, "scan": {"path": p, "new_sha256": f"n{i}"}, "delete": {"path": p}, "move": {"from": p, "to": q}, "sync_mode": {"path": p, "to_mode": rng.choice(["git", "manual"])}}.get(op, {})
        refs = [rng.choice(ids)] if ids and rng.random() < 0.6 else []
        if op == "ingest":
            ids.append(projection.genesis_id({"content_sha256": f"c{i}", "original_path": p, "ingest_op_id": f"o{i}", "origin_node": "m"}))
        out.append((op, a, refs, f"o{i}"))
    return out


def test_projection_equals_a_plain_replay(spark):
    rng = random.Random(3)
    kind = "member string, seq long, op_id string, op_type string, blob_refs array<string>, args map<string,string>, created_at timestamp, state string"
    for _ in range(3):
        log = random_log(rng, 300)
        df = spark.createDataFrame([("m", i, o, op, r, a, datetime(2024, 1, 1), "done") for i, (op, a, r, o) in enumerate(log)], kind).repartition(3)
        assert {(r.path, r.id, r.sha256, r.sync_mode) for r in projection.project(df).collect()} == fold_plain(log)
    for seed in range(200):
        log = random_log(random.Random(seed), 60)
        f = projection.Fold("m")
        for op, a, r, o in log:
            f.apply(op, a, r, o, None)
        assert {(r["path"], r["id"], r["sha256"], r["sync_mode"]) for r in f.rows.values()} == fold_plain(log)


def test_strict_fold_refuses():
    with pytest.raises(projection.Unapplicable):
        projection.Fold("m").apply("scan", {"path": "x"}, [], "o", None, strict=True)


MEMBERS = "name string, status string, answered boolean"


def resolve(spark, held=(), moves=(), down=(), home="A"):
    members = spark.createDataFrame([(m, "active", m not in down) for m in "ABC"], MEMBERS)
    q = spark.createDataFrame([("i", home)], "id string, home string")
    h = spark.createDataFrame([(m, "i") for m in held], "member string, id string")
    mv = spark.createDataFrame([(m, n, "i", s, to) for n, (m, s, to) in enumerate(moves)], "member string, seq long, id string, state string, moved_to string")
    r = federation.resolve(q, h, mv, members).first()
    return r.outcome, r.member, r.pointer


def test_resolution(spark):
    assert resolve(spark, held=["A"]) == ("found-at-home", "A", None)
    assert resolve(spark, held=["B"]) == ("found-elsewhere", "B", None)
    assert resolve(spark, down=["B"], home=None) == ("partial-view", None, None)
    assert resolve(spark) == ("missing", None, None)
    assert resolve(spark, moves=[("A", "done", "B")], held=["B"]) == ("found-elsewhere", "B", None)
    assert resolve(spark, moves=[("A", "done", "B")], down=["B"]) == ("partial-view", None, "B")
    assert resolve(spark, moves=[("A", "done", "B"), ("B", "done", "C")], held=["C"]) == ("found-elsewhere", "C", None)
    assert resolve(spark, moves=[("A", "done", "B"), ("B", "done", "A")])[0] == "error"
    assert resolve(spark, moves=[("A", "intent", "B")]) == ("partial-view", None, None)


def test_moves_pair_only_where_they_are_sure(spark):
    kind = "path string, kind string, sha256 string"
    f = spark.createDataFrame([("a", "deleted", "1"), ("b", "added", "1"), ("c", "deleted", "2"), ("d", "added", "2"), ("e", "added", "2")], kind)
    assert {(r.path, r.kind, r.old_path) for r in scan.pair_moves(f).collect()} == {("b", "moved", "a"), ("c", "deleted", None), ("d", "added", None), ("e", "added", None)}


def test_put(spark):
    cat = spark.createDataFrame([("m", "a.txt", "1"), ("m", "a (2).txt", "2")], "member string, path string, id string")
    new = spark.createDataFrame([("m", "a.txt", "9")], cat.schema)
    assert {r.path for r in pipelines.put(cat, new, "copy").table.collect()} == {"a.txt", "a (2).txt", "a (3).txt"}
    assert pipelines.put(cat, new).report.first().verdict == "refused" and pipelines.put(cat, new, None).report.first().verdict == "undecided"
    many = spark.createDataFrame([("m", p, i) for p, i in (("a.txt", "7"), ("a.txt", "8"), ("a (4).txt", "5"), ("b.txt", "3"), ("b.txt", "4"), (".b", "6"), (".b", "7"))], cat.schema)
    got = sorted((r.path, r.id) for r in pipelines.put(cat, many, "copy").table.collect())
    assert got == sorted([("a.txt", "1"), ("a (2).txt", "2"), ("a (3).txt", "7"), ("a (5).txt", "8"), ("a (4).txt", "5"), ("b.txt", "3"), ("b (2).txt", "4"), (".b", "6"), (".b (2)", "7")])
    assert sorted(r.id for r in pipelines.put(cat, many).table.collect()) == ["1", "2", "3", "5", "6"]
    named = spark.createDataFrame([("m", "a.txt", "7", "c.txt"), ("m", "a.txt", "8", "c.txt"), ("m", "a (2).txt", "9", "a.txt"), ("m", "d", "5", "e"), ("m", "d", "6", " ")], "member string, path string, id string, rename_to string")
    out = pipelines.put(cat, named, "rename")
    assert sorted((r.path, r.rank, r.final_path, r.verdict) for r in out.report.fillna("-").collect()) == [("a (2).txt", 1, "-", "refused"), ("a.txt", 1, "c.txt", "renamed"), ("a.txt", 2, "-", "refused"), ("d", 1, "d", "put"), ("d", 2, "-", "needs-name")]


def test_sweep_is_journaled(spark):
    cat = spark.createDataFrame([("m", f"p{i}", f"{i:02d}" + "0" * 62, f"s{i}", "git") for i in range(4)] + [("m", "q", "ff" + "0" * 62, "s0", "manual")], "member string, path string, id string, sha256 string, sync_mode string")
    obj = spark.createDataFrame([(f"s{i}",) for i in range(4)], "object_key string")
    plan = spark.createDataFrame([("s0", "eligible"), ("s1", "eligible"), ("s2", "kept"), ("s3", "eligible")], "object_key string, verdict string")
    log = spark.createDataFrame([("m", 0, "mv", "0" * 64, "h0", ["01" + "0" * 62], "intent")], CHAINED)
    out = pipelines.sweep_federated(obj, cat, plan, log, "r1")
    assert {r.object_key: r.verdict for r in out.report.collect()} == {"s0": "deleted", "s1": "skipped-pending", "s3": "deleted"}
    assert {r.path for r in out.table.collect()} == {"p1", "p2"}
    assert sorted((r.op_type, r.blob_refs[0][:2], r.seq) for r in out.intents.collect()) in ([("gc", "00", 1), ("gc", "03", 2)], [("gc", "00", 2), ("gc", "03", 1)])
    done = pipelines.gc_retry(out.intents, cat)
    assert {r.object_key for r in done.report.collect()} == {"s0", "s3"} and pipelines.gc_retry(out.intents, done.table).report.count() == 0


GEN = "content_sha256 string, original_path string, ingest_op_id string, origin_node string"


def test_moves_between_members_are_journaled(spark):
    cat = spark.createDataFrame([("a", f"p{i}", f"i{i}", f"s{i}", mode, 1, f"s{i}", f"p{i}", "o", "a") for i, mode in enumerate(["git", "manual", "git", "git", "git"])], f"member string, path string, id string, sha256 string, sync_mode string, size long, {GEN}")
    mv = spark.createDataFrame([("a", f"p{i}", "b", f"q{i}") for i in range(6)], "member string, path string, to_member string, to_path string")
    obj = spark.createDataFrame([("s0", "s0"), ("s1", "new1"), ("s2", "rot"), ("s4", "s4")], "object_key string, observed_sha string")
    log = spark.createDataFrame([("b", 0, "x", "0" * 64, "h", ["i4"], "intent")], CHAINED)
    out = pipelines.move_across(cat, mv, obj, log)
    assert {r.path: r.verdict for r in out.report.collect()} == {"p0": "moved", "p1": "rehomed", "p2": "corrupt", "p3": "no-bytes", "p4": "blocked", "p5": "no-file"}
    assert {(r.member, r.path, r.id, r.sha256) for r in out.table.collect()} == {("b", "q0", "i0", "s0"), ("b", "q1", "i1", "new1"), ("a", "p2", "i2", "s2"), ("a", "p3", "i3", "s3"), ("a", "p4", "i4", "s4")}
    ends = {(r.member, r.blob_refs[0]): r.args for r in out.intents.where("verdict = 'appended'").collect()}
    assert ends["a", "i0"]["moved_to"] == "b" and ends["b", "i1"]["dest_path"] == "q1" and ("b", "i4") not in ends


def test_scan_skips_what_is_in_flight(spark):
    cat = spark.createDataFrame([("m", p, f"id-{p}", f"s-{p}", 1, "manual", 100, "c", p, "o", "m") for p in ("same", "edit", "gone", "busy", "rot", "old")], f"member string, path string, id string, sha256 string, size long, sync_mode string, last_scanned_s long, {GEN}")
    disk = spark.createDataFrame([("same", "s-same", 1, 200), ("edit", "new", 2, 200), ("busy", "new2", 2, 200), ("rot", "bad", 1, 50), ("renamed", "s-old", 1, 50), ("fresh", "f", 3, 50)], "path string, sha256 string, size long, mtime_s long")
    log = spark.createDataFrame([("m", 0, "x", "0" * 64, "h", ["id-busy"], "intent")], CHAINED)
    cat2 = cat.where("path <> 'rot'").unionByName(cat.where("path = 'rot'").withColumn("last_scanned_s", F.lit(10).cast("long")))
    disk2 = disk.withColumn("size", F.when(F.col("path") == "rot", 1).otherwise(F.col("size")))
    out = pipelines.apply_scan(cat2, disk2, log, "m", 300)
    assert {(r.path, r.kind): r.verdict for r in out.report.collect()} == {("same", "verified"): "applied", ("edit", "edited"): "applied", ("gone", "deleted"): "applied", ("busy", "edited"): "skipped-in-flight", ("rot", "edited"): "applied", ("renamed", "moved"): "applied", ("fresh", "added"): "applied"}
    got = {r.path: (r.sha256, r.size, r.last_scanned_s, r.id) for r in out.table.collect()}
    assert set(got) == {"same", "edit", "busy", "rot", "renamed", "fresh"} and got["busy"] == ("s-busy", 1, 100, "id-busy") and got["edit"] == ("new", 2, 300, "id-edit") and got["same"][2] == 300 and got["renamed"][3] == "id-old" and got["fresh"][:3] == ("f", 3, 300)
    again = pipelines.apply_scan(cat2, disk2, log.unionByName(out.intents.where("verdict = 'appended'").select(*log.columns)), "m", 300)
    assert sorted(map(tuple, again.table.collect())) == sorted(map(tuple, out.table.collect()))


def test_rosters_across_members(spark):
    roster = spark.createDataFrame([("a", "na", 1, "active"), ("b", "nb", 2, "left")], "name string, node string, joined_at_s long, status string")
    assert sorted(map(tuple, pipelines.join_federation(roster, "a", "x", 9).collect())) == sorted(map(tuple, roster.collect()))
    joined = pipelines.join_federation(roster, "b", "x", 9)
    assert ("b", "x", 9, "active") in set(map(tuple, joined.collect())) and joined.count() == 2
    t = spark.createDataFrame([("a", True, True), ("b", False, False)], "name string, answered boolean, permitted boolean")
    assert {r.name: r.result for r in federation.fan_out(t).collect()} == {"a": "applied", "b": "pending"}
    assert {r.result for r in federation.fan_out(t.withColumn("answered", F.lit(True))).collect()} == {"refused"}
    copies = spark.createDataFrame([("a", "f", "old", "n", 0, "active"), ("c", "f", "kept", "n", 0, "active")], "observer string, fed_id string, name string, node string, joined_at_s long, status string")
    obs = spark.createDataFrame([("a",), ("b",)], "observer string")
    out = pipelines.write_roster(copies, obs, roster, spark.createDataFrame([("a",)], "member string"), spark.createDataFrame([], CHAINED), "f", "join", "b")
    assert {r.observer: r.verdict for r in out.report.collect()} == {"a": "written", "b": "no-catalog"}
    assert {(r.observer, r.name) for r in out.table.collect()} == {("a", "a"), ("a", "b"), ("c", "kept")}
    with pytest.raises(ValueError):
        federation.load_roster(copies.withColumn("fed_id", F.col("observer")), copies)
    with pytest.raises(ValueError):
        federation.roster_of_catalog(copies, "nobody")
    assert federation.discover_roster(copies, copies, via="a").first().name == "old"
    m = spark.createDataFrame([("a", "active", True), ("b", "active", False), ("c", "left", False)], MEMBERS)
    assert federation.reach_tally(m).first()[:] == (1, 2, "b")
    cat = spark.createDataFrame([("a", "p", "i1"), ("b", "q", "i2")], "member string, path string, id string")
    snap = spark.createDataFrame([("b", 0, ["i7", "i8"]), ("b", 1, ["i9"])], "name string, generation int, ids array<string>")
    assert {tuple(r) for r in federation.live_or_cached(cat, m, snap).collect()} == {("a", "i1", "p", False), ("b", "i7", None, True), ("b", "i8", None, True)}
    new = federation.snapshot_of(cat, m, 5)
    assert [tuple(r) for r in new.collect()] == [("a", "active", 5, 1, ["i1"])]
    kept = federation.rotate(snap.select("name", "generation"), new.select("name"))
    assert {tuple(r) for r in kept.select("name", "generation").collect()} == {("a", 0), ("b", 1)}


def test_replay_is_strict(spark):
    kind = "member string, seq long, op_id string, op_type string, blob_refs array<string>, args map<string,string>, created_at timestamp, state string"
    log = spark.createDataFrame([("m", 0, "o0", "ingest", [], {"path": "p", "content_sha256": "c"}, datetime(2024, 1, 1), "done")], kind)
    cat = projection.project(log)
    op = spark.createDataFrame([("m", 1, "o1", "scan", [], {"path": "p", "new_sha256": "n"}, datetime(2024, 1, 2), "intent")], kind)
    assert [(r.path, r.sha256) for r in projection.replay(cat, op).collect()] == [("p", "n")]
    with pytest.raises(Exception, match="no row at nowhere"):
        projection.replay(cat, op.withColumn("args", F.create_map(F.lit("path"), F.lit("nowhere")))).collect()


def test_lookups(spark):
    rows = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first"), ("b", 5, "only")], "path string, pos int, v string")
    assert {r.path: r.v for r in lookup.first_by(rows, "path").collect()} == {"a": "first", "b": "only"} and {r.path: r.v for r in lookup.last_by(rows, "path").collect()} == {"a": "second", "b": "only"}
    assert {r.path: (r.found, r.v) for r in lookup.find(spark.createDataFrame([("a",), ("z",)], "path string"), rows, "path").collect()} == {"a": (True, "first"), "z": (False, None)}
    many = spark.createDataFrame([(f"p{i:02d}",) for i in range(30)], "path string")
    assert [tuple(r) for r in lookup.sample(many, "path", 2).collect()] == [("p00", 28), ("p01", 28)]
    left = lookup.deselect(many, spark.createDataFrame([(1,), (30,)], "index int"))
    assert {r.path for r in left.collect()} == {f"p{i:02d}" for i in range(1, 29)}


def test_empty_tables(spark):
    t = spark.createDataFrame([], "path string, sha256 string")
    lk = lock(spark, []).limit(0)
    o = spark.createDataFrame([], "object_key string, observed_sha string")
    assert status.classify(t, lk).count() == status.push_plan(t, lk, o).count() == locks.corrupt(o).count() == 0
    assert scan.worst(spark.createDataFrame([], "path string, kind string")).first().exit_code == 0


def test_pairs_that_wait_are_not_shuffled(spark):
    rng = random.Random(12)
    rows = [(rng.choice("mn"), seq, rng.choice(["a", "b", None]) if seq % 9 == 0 else f"op{seq}", "", "", None if seq % 11 == 0 else [rng.choice([*"uvwxyz", None]) for _ in range(rng.randrange(6))], rng.choice(["intent", "failed", "done"])) for seq in range(120)]
    log = spark.createDataFrame(rows, CHAINED)
    open_ = [r for r in rows if r[6] != "done"]
    want = sorted({(a[0], str(a[2]), str(b[2])) for a in open_ for b in open_ if a[0] == b[0] and b[1] < a[1] and {*(a[5] or ())} & {*(b[5] or ())} - {None}})
    for wide in (32, 2, 0):
        assert sorted((r.member, str(r.op_id), str(r.waits_on)) for r in wal.waits_on_ops(log, wide).collect()) == want and len(want) > 100
    # Of operations with few refs no pair meets another after the join: it is the plan's last exchange.
    plan = wal.waits_on_ops(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.splitlines()[2].lstrip(" :+-").startswith("Join")
