from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stratacat.operators import projection, wal
from stratacat.sources import files, sinks
from stratacat.streaming import projection as live


def write(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def test_tree_and_objects(spark, tmp_path):
    sha = hashlib.sha256(b"hello").hexdigest()
    write(tmp_path, "t/a/x.txt", "hello")
    write(tmp_path, "t/p.bin", f"m.v1\nsha256 {sha}\nsize 77\nlocation n\n")
    write(tmp_path, "t/meta/z", "no")
    write(tmp_path, "t/b.tmp", "")
    write(tmp_path, f"t/objects/{sha}", "hello")
    got = {(r.path, r.sha256, r.size) for r in files.tree(spark, str(tmp_path / "t"), "m.v1").where("path in ('a/x.txt', 'p.bin')").collect()}
    assert got == {("a/x.txt", sha, 5), ("p.bin", sha, 77)}
    assert files.tree(spark, str(tmp_path / "t"), "m.v1").where("path = 'b.tmp'").first()[1:] == (hashlib.sha256(b"").hexdigest(), 0)
    assert {(r.path, r.kept) for r in files.walk(spark, str(tmp_path / "t"), [("*.tmp", False)]).collect()} == {("a/x.txt", True), ("p.bin", True), ("b.tmp", False)}
    assert files.objects(spark, str(tmp_path / "t"), "n").where("object_key = observed_sha").count() == 1


def test_documents(spark, tmp_path):
    write(tmp_path, "lock.toml", 'version = 2\n[[entry]]\npath = "a"\nsha256 = "s"\nsize = 3\npushed_at = 2024-01-01T00:00:00Z\nversions = ["v"]\n')
    r = files.lock(spark, str(tmp_path / "lock.toml")).first()
    assert (r.path, r.size, r.deleted, r.versions, r.pushed_at) == ("a", 3, False, ["v"], datetime(2024, 1, 1))
    write(tmp_path, "cat.toml", 'version = 2\nnode = "n"\n[[file]]\npath = "a"\nid = "i"\n[file.genesis]\ncontent_sha256 = "c"\n[federation]\nid = "f"\n[[federation.member]]\nname = "n"\nstatus = "active"\n')
    assert files.catalog(spark, str(tmp_path / "cat.toml")).select("member", "sync_mode", "genesis.content_sha256").first()[:] == ("n", "manual", "c")
    assert files.roster(spark, str(tmp_path / "cat.toml")).select("observer", "fed_id", "name").first()[:] == ("n", "f", "n")
    with pytest.raises(files.BadVersion):
        files.config("version = 2")
    assert files.config('version = 1\n[rules]\ninclude = ["**/*.pdf"]')["min_size"] == "5MB"
    assert files.locations(spark, None).count() == 0
    js = spark.createDataFrame([('{"Peer": {"k": {"HostName": "", "DNSName": "a.b.", "Online": true, "IPs": ["1.2.3.4"]}, "l": {"HostName": ""}}}',)], "value string")
    assert files.peers(js).first()[:] == ("1.2.3.4", "a.b", True, ["1.2.3.4"])


def test_wal_files_round_trip(spark, tmp_path):
    log = spark.createDataFrame([], "member string, seq long, op_id string, prev_hash string, self_hash string, blob_refs array<string>, state string")
    cand = spark.createDataFrame([("m", i, f"o{i}", "ingest", [f"b{i}"], "me", "2024-01-01T00:00:00Z", {"path": f'p"{i}', "content_sha256": "c"}) for i in range(4)], "member string, position long, op_id string, op_type string, blob_refs array<string>, actor string, created_at string, args map<string,string>")
    made = wal.append(log, cand)
    sinks.write_wal_files(made, str(tmp_path / "out"))
    for r in spark.read.json(str(tmp_path / "out")).collect():
        write(tmp_path, f"n/meta/wal/{r.name}", r.text)
    write(tmp_path, "n/meta/wal/000000000001.done", "")
    write(tmp_path, "n/meta/wal/000000000002.failed", "")
    got = files.wal(spark, str(tmp_path / "n"), "m").orderBy("seq").collect()
    assert [(r.self_hash, r.state) for r in got] == list(zip([r.self_hash for r in made.orderBy("seq").collect()], ["intent", "done", "failed", "intent"], strict=True))
    assert got[2].args["path"] == 'p"2'


def test_sinks_are_idempotent(spark, tmp_path):
    obj = spark.createDataFrame([("a",), ("b",)], "object_key string")
    for _ in range(2):
        there = spark.read.parquet(str(tmp_path / "o")) if (tmp_path / "o").exists() else obj.limit(0)
        sinks.put_new(obj, spark.createDataFrame(there.collect(), obj.schema), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    sinks.write_table(spark.createDataFrame([("b", 1), ("a", 2)], "path string, n int"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for m in ("x", "y"):
        for i in range(30):
            op, a = [("ingest", {"path": f"p{i % 4}", "content_sha256": f"c{i}"}), ("scan", {"path": f"p{i % 3}", "new_sha256": f"n{i}"}), ("move", {"from": f"p{i % 4}", "to": f"p{i % 5}"})][i % 3]
            rows.append((m, i, f"{m}{i}", op, [], a, datetime(2024, 1, 1), "failed" if i % 7 == 3 else "done"))
    log = spark.createDataFrame(rows, live.LOG)
    order = [3, 0, 2, 1]  # later entries come first
    for k, part in enumerate(order):
        log.where(F.col("seq") % 4 == part).coalesce(1).write.parquet(str(tmp_path / f"log/{k}"))
    stream = spark.readStream.schema(live.LOG).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    seen = {}

    def sink(df, _):
        for m, rs in df.groupBy("member").agg(F.collect_set(F.struct("path", "id", "sha256")).alias("r")).collect():
            seen[m] = {tuple(r) for r in rs}

    live.start(stream, sink, str(tmp_path / "cp")).awaitTermination(120)
    want = {}
    for r in projection.project(log).collect():
        want.setdefault(r.member, set()).add((r.path, r.id, r.sha256))
    assert seen == want


def test_an_intent_counts_when_it_is_done(spark, tmp_path):
    entry = lambda seq, op, a, state: ("m", seq, f"o{seq}", op, [], a, datetime(2024, 1, 1), state)
    first = [entry(0, "ingest", {"path": "p", "content_sha256": "c"}, "intent"), entry(1, "scan", {"path": "p", "new_sha256": "n"}, "done")]
    parts = [first, [entry(0, "ingest", {"path": "p", "content_sha256": "c"}, "done")], first[:1]]
    seen = []

    def sink(df, _):
        seen.append({(r.path, r.sha256) for r in df.collect()})

    for k, part in enumerate(parts):
        spark.createDataFrame(part, live.LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        live.start(live.read_log(spark, str(tmp_path / "log")), sink, str(tmp_path / "cp")).awaitTermination(120)
        assert seen[-1] == (set() if k == 0 else {("p", "n")})


def test_stores(spark, tmp_path):
    for k in range(5):
        write(tmp_path, f"s/a/b/c/d/x{k}.bin", "q" * k)
    write(tmp_path, "s/top", "t")
    write(tmp_path, "s/.git/HEAD", "ref")
    (tmp_path / "s/link").symlink_to(tmp_path / "s/top")
    root = str(tmp_path / "s")
    assert {(r.path, r.size) for r in files.listing(spark, root).collect()} == {("top", 1), (".git/HEAD", 3), *((f"a/b/c/d/x{k}.bin", k) for k in range(5))}
    assert files.listing(spark, str(tmp_path / "nowhere")).count() == 0
    assert {(r.key, r.size) for r in files.keys(spark, root, "a/b/c/d/x3").collect()} == {("a/b/c/d/x3.bin", 3)} and files.keys(spark, root, "zz/").count() == 0
    rules = {"min_size": 3, "include": ["top"], "exclude": [], "history": False, "overrides": []}
    assert {r.path for r in files.managed_files(spark, root, rules).collect()} == {"top", "a/b/c/d/x3.bin", "a/b/c/d/x4.bin"}
    assert {r.path for r in files.tree(spark, root, "m.v1", F.col("size") >= 4).collect()} == {"a/b/c/d/x4.bin"}
    assert files.catalog(spark, str(tmp_path / "no.toml"), absent_ok=True).count() == files.snapshots(spark, str(tmp_path / "no")).count() == 0


def test_documents_written_are_read_again(spark, tmp_path):
    g = ("c" * 64, 'o"p', "op", "n")
    lk = spark.createDataFrame([("b", "i", g, "s", 3, "n", datetime(2024, 1, 2, 3, 4, 5), "me", True, False, True, ["v2", "v1"]), ("a", "", None, "t", 0, "n", None, "", False, True, False, ["x"])], "path string, id string, genesis struct<content_sha256: string, original_path: string, ingest_op_id: string, origin_node: string>, sha256 string, size long, location string, pushed_at timestamp, pusher string, history boolean, preserve boolean, deleted boolean, versions array<string>")
    write(tmp_path, "lock.toml", sinks.document_head("lock") + "".join(r.text for r in sinks.lock_text(lk).orderBy("path").collect()))
    got = {r.path: r for r in files.lock(spark, str(tmp_path / "lock.toml")).collect()}
    assert got["b"].genesis[:] == g and got["b"].versions == ["v2", "v1"] and got["b"].pushed_at == datetime(2024, 1, 2, 3, 4, 5) and got["b"].deleted and got["b"].pusher == "me"
    assert got["a"].id is None and got["a"].versions is None and got["a"].preserve
    cat = spark.createDataFrame([("n", "i", g, "s", "p", "git", 5, datetime(2024, 1, 1), None, None)], "member string, id string, genesis struct<content_sha256: string, original_path: string, ingest_op_id: string, origin_node: string>, sha256 string, path string, sync_mode string, size long, created_at timestamp, updated_at timestamp, last_scanned timestamp")
    write(tmp_path, "cat.toml", sinks.document_head("catalog", node="n") + "".join(r.text for r in sinks.catalog_text(cat).collect()))
    assert files.catalog(spark, str(tmp_path / "cat.toml")).first() == cat.select(*files.catalog(spark, str(tmp_path / "cat.toml")).columns).first()
    rules = files.CONFIG | {"include": ["**/*.pdf"], "override": [{"match": "a/**", "history": True}]}
    assert files.config(sinks.config_text(rules, "home")) == rules
    with pytest.raises(ValueError):
        files.config('version = 1\n[rules]\nmin_size = "lots"')
    loc = spark.createDataFrame([("x", "", "/x", "local", "", ""), ("y.z", "n", "/y", "ssh", "u", "")], "name string, node string, base_path string, backend string, user string, share string")
    back = files.locations(spark, "".join(r.text for r in sinks.locations_text(loc).orderBy("name").collect()))
    assert {(r.name, r.base_path, r.user) for r in back.collect()} == {("x", "/x", None), ("y.z", "/y", "u")}
    assert files.location_at(loc, "/x/deep") == "x"
    with pytest.raises(LookupError):
        files.location_at(loc, "/elsewhere")
    with pytest.raises(ValueError):
        sinks.registry_add(loc, loc.withColumn("backend", F.lit("odd")))
    with pytest.raises(LookupError):
        sinks.registry_remove(loc, "q")
    assert sinks.registry_add(loc, loc.where("name = 'x'").withColumn("base_path", F.lit("/z"))).count() == 2 and sinks.registry_remove(loc, "x").count() == 1
    write(tmp_path, "rec.toml", "".join(f"{k} = '{v}'\n" for k, v in zip(("content_sha256", "original_path", "ingest_op_id", "origin_node"), g, strict=True)))
    assert files.records(spark, str(tmp_path / "rec.toml")).first().original_path == 'o"p'


def test_tables_replace_what_they_are_read_from(spark, tmp_path):
    t = str(tmp_path / "t")
    sinks.replace_table(spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int"), t, "key")
    new = sinks.put_over(sinks.current_table(spark, t), spark.createDataFrame([("b", 9), ("c", 3)], "key string, v int"))
    sinks.replace_table(sinks.delete_keys(new, spark.createDataFrame([("a",), ("zz",)], "key string")), t, "key")
    assert {tuple(r) for r in sinks.current_table(spark, t).collect()} == {("b", 9), ("c", 3)}
    refs = sinks.refs_table(spark.createDataFrame([("p", 0, "x"), ("q", 0, "y")], "path_id string, pos int, sha256 string"), spark.createDataFrame([("p", ["n", "x"]), ("q", [])], "path_id string, versions array<string>"))
    assert {r.path_id: r.text for r in sinks.refs_text(refs).collect()} == {"p": "n\nx\n"}
    lines = [r.text for r in sinks.aligned(spark.createDataFrame([("b", 10), ("long", None)], "name string, n int"), "name").collect()]
    assert lines == ["NAME  N", "b     10", "long"]
