"""Sources: directory listings, object inventories, text and TOML tables, logs, network status."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacat import schemas
from stratacat.functions import globs, identity, scalars


class BadVersion(ValueError):
    """A document of another version than is read here."""


LISTED = "path string, size long, mtime timestamp"
#: Bytes of a file that a task reads at once.
CHUNK = 8 << 20


def _store(uri: str):  # noqa: ANN202
    """The file system of a path and the path there, for tasks: file, hdfs, s3 and what else pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{os.path.abspath(uri)}")


def listing(spark: SparkSession, root: str, spread: int = 2) -> DataFrame:
    """path (below root), size, mtime of every file below root, empty ones too; contents aren't read, links aren't followed, a missing root has none.

    The first `spread` levels are listed one after the other, each folder by a task of its own; every folder below is walked by the task that has it. The driver sees no name.
    """
    folders = "folder string, path string, size long, mtime timestamp"

    def level(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            store, top = _store(root)
            top = top.rstrip("/")
            kinds = [("folder", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))]
            linked = (lambda p: os.path.islink(p)) if isinstance(store, fs.LocalFileSystem) else (lambda p: False)
            for b in batches:
                for folder in b.column(0).to_pylist():
                    todo = [folder]
                    while todo:
                        at = todo.pop()
                        out: list[tuple] = []
                        for f in store.get_file_info(fs.FileSelector(f"{top}/{at}".rstrip("/"), allow_not_found=True)):
                            name = f.path[len(top) + 1 :]
                            if linked(f.path):
                                continue
                            if f.type == fs.FileType.Directory:
                                if deep:
                                    todo.append(name)
                                else:
                                    out.append((name, None, None, None))
                            else:
                                out.append((None, name, f.size, f.mtime))
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

        return run

    now, files = spark.createDataFrame([("",)], "folder string"), None
    for i in range(spread + 1):
        found = now.mapInArrow(level(i == spread), folders)
        some = found.where("path is not null").drop("folder")
        files = some if files is None else files.unionByName(some)
        now = found.where("folder is not null").select("folder").repartition("folder")
    return files


def _hashed(files: DataFrame, root: str, head: int = 4096) -> DataFrame:
    """files (path, size) with sha256 of their bytes and head, the first bytes of files up to that many: read in pieces, so a file may be larger than a task's memory. A file that has gone since it was listed is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, top = _store(root)
        for b in batches:
            rows = []
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    with store.open_input_stream(f"{top.rstrip('/')}/{path}") as f:
                        h, first = hashlib.sha256(), None
                        while piece := f.read(CHUNK):
                            first = piece if first is None and len(piece) <= head else first or b""
                            h.update(piece)
                except FileNotFoundError:
                    continue
                rows.append({"path": path, "size": size, "sha256": h.hexdigest(), "head": first})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("head", pa.binary())]))

    return files.select("path", "size").repartition("path").mapInArrow(run, "path string, size long, sha256 string, head binary")


def walk(spark: SparkSession, root: str, ignore: Sequence[tuple[str, bool]] = (), explicit: DataFrame | None = None, own: Sequence[str] = (".ignore",)) -> DataFrame:
    """listing with kept: false for paths that the ignore list takes out and no row of explicit (path) takes back. Reserved keys and own files aren't listed."""
    d = listing(spark, root).where(~globs.reserved(F.col("path")) & ~F.col("path").isin(*own))
    named = F.lit(False)
    if explicit is not None:
        d = d.join(explicit.select("path", F.lit(True).alias("__named")).distinct(), "path", "left")
        named = F.coalesce("__named", F.lit(False))
    return d.withColumn("kept", ~globs.ignored(F.col("path"), ignore, named)).drop("__named")


def tree(spark: SparkSession, root: str, magic: str, managed: Column | None = None) -> DataFrame:
    """path, sha256, size of the files below root; a pointer file counts as the content that it names. managed: a condition on path and size, applied before any file is read. Reserved folders of version control aren't looked at."""
    files = listing(spark, root).where(~F.col("path").rlike(r"(^|/)\.git(/|$)"))
    d = _hashed(files if managed is None else files.where(managed), root)
    p = identity.pointer(F.col("head").cast("string"), magic)
    return d.select("path", F.coalesce(p["sha256"], "sha256").alias("sha256"), F.coalesce(p["size"], "size").alias("size"))


def managed_files(spark: SparkSession, root: str, rules: dict[str, Any]) -> DataFrame:
    """path, size of the files below root that the rules (globs.evaluate's arguments) manage; version control's own files and reserved keys are none."""
    files = listing(spark, root).where(~F.col("path").rlike(r"(^|/)\.git(/|$)") & ~globs.reserved(F.col("path")))
    return files.where(globs.evaluate(F.col("path"), F.col("size"), **rules)["managed"]).select("path", "size")


def keys(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """key, size of the objects of a store below root whose key starts with prefix; none for a missing root."""
    folder = prefix.rsplit("/", 1)[0] + "/" if "/" in prefix else ""
    d = listing(spark, f"{root}/{folder}".rstrip("/")).select(F.concat(F.lit(folder), "path").alias("key"), "size")
    return d.where(F.col("key").startswith(prefix))


def objects(spark: SparkSession, root: str, member: str = "") -> DataFrame:
    """member, object_key, size, observed_sha of the files below root/objects."""
    d = _hashed(listing(spark, f"{root}/objects"), f"{root}/objects")
    return d.select(F.lit(member).alias("member"), F.substring_index("path", "/", -1).alias("object_key"), "size", F.col("sha256").alias("observed_sha"))


def _documents(spark: SparkSession, path: str, rows: Callable[[str, dict[str, Any], bytes], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = [{f.name: r.get(f.name) for f in out} for r in rows(name, tomllib.loads(content.decode()), content)]
                yield pa.RecordBatch.from_pylist(made, schema=out)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)


def _versioned(doc: dict[str, Any], kind: str, name: str) -> None:
    if doc.get("version") != schemas.VERSIONS[kind]:
        raise BadVersion(f"{name}: {kind} version {doc.get('version')}, not {schemas.VERSIONS[kind]}")


def lock(spark: SparkSession, path: str, branch: str = "main") -> DataFrame:
    """The entries of lock documents. Missing flags are false; another version fails."""

    def rows(name: str, doc: dict[str, Any], _: bytes) -> Iterator[dict[str, Any]]:
        _versioned(doc, "lock", name)
        for e in doc.get("entry", []):
            yield {"history": False, "preserve": False, "deleted": False, **e, "branch": branch}

    return _documents(spark, path, rows, schemas.LOCK)


def catalog(spark: SparkSession, path: str, absent_ok: bool = False) -> DataFrame:
    """The files of catalog documents, with the member that the document names. With absent_ok a path that isn't there has no rows: a member without a catalog holds nothing."""

    def rows(name: str, doc: dict[str, Any], _: bytes) -> Iterator[dict[str, Any]]:
        _versioned(doc, "catalog", name)
        for e in doc.get("file", []):
            yield {"sync_mode": "manual", **e, "member": doc.get("node") or doc.get("vault_name")}

    if absent_ok and _absent(path):
        return spark.createDataFrame([], schemas.CATALOG)
    return _documents(spark, path, rows, schemas.CATALOG)


def _absent(path: str) -> bool:
    from pyarrow import fs

    store, at = _store(path)
    return store.get_file_info(at).type == fs.FileType.NotFound


def records(spark: SparkSession, path: str) -> DataFrame:
    """id and the four fields of birth records, a document each: of a receipt's shape (a table genesis) or of the four lines alone."""

    def rows(_: str, doc: dict[str, Any], __: bytes) -> Iterator[dict[str, Any]]:
        g = doc.get("genesis", doc)
        yield {"id": doc.get("id"), **{k: g.get(k) for k in identity.GENESIS}}

    d = _documents(spark, path, rows, "id string, content_sha256 string, original_path string, ingest_op_id string, origin_node string")
    return d.withColumn("id", F.coalesce("id", identity.mint_id({k: F.col(k) for k in identity.GENESIS})))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """The two generations kept of what members were known to hold (Parquet, schemas.SNAPSHOT); none where there is no such path."""
    if _absent(path):
        return spark.createDataFrame([], schemas.SNAPSHOT)
    return spark.read.schema(schemas.SNAPSHOT).parquet(path).where("generation < 2")


def location_at(locations: DataFrame, folder: str) -> str:
    """The name of the one local location whose base_path is the folder or above it; none or several is an error."""
    at = F.regexp_replace(F.col("base_path"), "/+$", "")
    names = [r[0] for r in locations.where((F.lit(folder) == at) | F.lit(folder).startswith(F.concat(at, F.lit("/")))).select("name").orderBy("name").limit(3).collect()]
    if len(names) != 1:
        raise LookupError(f"{folder} is in {'no location' if not names else ' and '.join(names)}")
    return names[0]


def roster(spark: SparkSession, path: str) -> DataFrame:
    """The member rows of catalog documents' federation tables, by the document's node as observer."""

    def rows(_: str, doc: dict[str, Any], __: bytes) -> Iterator[dict[str, Any]]:
        fed = doc.get("federation") or {}
        for m in fed.get("member", []) or fed.get("members", []):
            yield {**m, "observer": doc.get("node"), "fed_id": fed.get("id") or fed.get("fed_id")}

    return _documents(spark, path, rows, schemas.ROSTER)


def receipts(spark: SparkSession, path: str) -> DataFrame:
    return _documents(spark, path, lambda _, doc, __: iter([doc]), schemas.RECEIPT)


def wal(spark: SparkSession, root: str, member: str) -> DataFrame:
    """The log below root/meta/wal: entries <seq>.toml, their markers .done and .failed beside them. self_hash is of an entry's bytes as they are."""

    def rows(name: str, doc: dict[str, Any], content: bytes) -> Iterator[dict[str, Any]]:
        import hashlib

        yield {**doc, "member": member, "args": list((doc.get("args") or {}).items()), "self_hash": hashlib.sha256(content).hexdigest(), "state": "intent"}

    from stratacat.operators.wal import effective_state

    top = f"{root}/meta/wal"
    entries = _documents(spark, f"{top}/*.toml", rows, schemas.WAL).drop("state")
    names = listing(spark, top).select(F.substring_index("path", "/", -1).alias("name"))
    mark = lambda s: names.select(F.lit(member).alias("member"), scalars.seq_of_marker(F.col("name"), s).alias("seq"), F.lit(s).alias("mark")).where("seq is not null")
    return effective_state(entries, mark("done").unionByName(mark("failed")))


def refs(spark: SparkSession, path: str) -> DataFrame:
    """path_id, pos, sha256 of version lists, one file a path, newest first."""
    d = spark.read.text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("path_id"), F.posexplode(scalars.split_lines(F.col("value"))).alias("pos", "sha256"))
    return d


CONFIG = {"history": False, "min_size": "5MB", "include": [], "exclude": [], "auto_delete": True, "override": []}


def config(text: str) -> dict[str, Any]:
    """Rules of a config document over the defaults. Globs and sizes are checked; a document that names a location must name one."""
    doc = tomllib.loads(text)
    _versioned(doc, "config", "config")
    if "location" in doc and not doc["location"]:
        raise ValueError("config: location is empty")
    size = str(doc.get("rules", {}).get("min_size", CONFIG["min_size"]))
    if not re.match(r"(?i)^\s*([0-9]+|[0-9]*\.?[0-9]+\s*[KMGT]?I?B)\s*$", size):
        raise ValueError(f"config: {size!r} is no size")
    rules = {**CONFIG, **doc.get("rules", {})}
    for g in [*rules["include"], *rules["exclude"], *(o["match"] for o in rules["override"])]:
        globs.to_regex(g)
    return rules


def locations(spark: SparkSession, text: str | None) -> DataFrame:
    """The rows of a locations document; none for no document."""
    doc = tomllib.loads(text or "").get("locations", {})
    fields = [f.split()[0] for f in schemas.LOCATIONS.split(", ")]
    return spark.createDataFrame([tuple({"name": n, **v}.get(f) for f in fields) for n, v in sorted(doc.items())], schemas.LOCATIONS)


def peers(status: DataFrame, text: Column | str = "value", addresses: str = "IPs") -> DataFrame:
    """name, dns, online, ips of a network status document's peers: JSON with a map of peers. A name falls back to the first address (the field addresses); those without either are left out."""
    kind = f"Peer map<string, struct<HostName: string, DNSName: string, Online: boolean, {addresses}: array<string>>>"
    p = status.select(F.explode(F.map_entries(F.from_json(text, kind)["Peer"])).alias("p")).select("p.value.*")
    name = F.coalesce(F.nullif("HostName", F.lit("")), F.get(addresses, F.lit(0)))
    return p.select(name.alias("name"), scalars.trim_dot(F.col("DNSName")).alias("dns"), F.coalesce("Online", F.lit(False)).alias("online"), F.col(addresses).alias("ips")).where("coalesce(name, '') <> ''")
