"""Catalogs as projections of operation logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacat.functions.identity import ESCAPES, GENESIS

CATALOG = "member string, path string, id string, sha256 string, sync_mode string, size long, content_sha256 string, original_path string, ingest_op_id string, origin_node string, created_at timestamp, updated_at timestamp, last_scanned timestamp"
COLUMNS = [f.split()[0] for f in CATALOG.split(", ")]


class Unapplicable(ValueError):
    """An operation that a strict fold can't apply."""


def genesis_id(g: dict[str, str]) -> str:
    text = "".join(f'{k} = "{"".join(ESCAPES.get(c, c) for c in g[k] or "")}"\n' for k in GENESIS)
    return hashlib.sha256(text.encode()).hexdigest()


class Fold:
    """A member's catalog while its log is read: rows by path, and by id the paths that have it in the order that they took it."""

    def __init__(self, member: str, rows: Iterable[dict[str, Any]] = ()) -> None:
        self.member, self.rows, self.by_id = member, {}, {}
        for r in rows:
            self.put(dict(r))

    def put(self, row: dict[str, Any]) -> None:
        """Takes the place of the row at its path, if there is one."""
        old = self.rows.get(row["path"])
        if old is not None and old["id"] != row["id"]:
            self.by_id[old["id"]].pop(old["path"], None)
        self.rows[row["path"]] = row
        self.by_id.setdefault(row["id"], {})[row["path"]] = None

    def drop(self, path: str | None) -> None:
        if (old := self.rows.pop(path, None)) is not None:
            self.by_id[old["id"]].pop(path, None)

    def with_id(self, ident: str) -> dict[str, Any] | None:
        path = next(iter(self.by_id.get(ident, ())), None)
        return None if path is None else self.rows[path]

    def apply(self, op: str, args: dict[str, str], refs: list[str], op_id: str, at: Any, strict: bool = False) -> None:
        """One done operation. Unless strict, types it doesn't know and targets that aren't there change nothing."""
        a, row = args.get, self.rows.get(args.get("path"))
        if op == "ingest":
            g = {"content_sha256": a("content_sha256") or "", "original_path": a("path") or "", "ingest_op_id": op_id, "origin_node": self.member}
            if g["content_sha256"] and g["original_path"] and g["ingest_op_id"]:
                self.put({"member": self.member, "path": a("path"), "id": genesis_id(g), "sha256": a("content_sha256"), "sync_mode": a("sync_mode") or "manual", "size": _int(a("size")), **g, "created_at": at, "updated_at": at, "last_scanned": at})
        elif op == "scan":
            if row is None:
                if strict:
                    raise Unapplicable(f"{op_id}: no row at {a('path')}")
                return
            self.put({**row, "sha256": a("new_sha256") or row["sha256"], "updated_at": at, "last_scanned": at})
        elif op == "delete":
            self.drop(a("path"))
        elif op == "move" and a("moved_to"):
            self._drop_ids(refs)
        elif op == "move" and a("dest_path") and a("id"):
            self.put({"member": self.member, "path": a("dest_path"), "id": a("id"), "sha256": a("content_sha256"), "sync_mode": a("sync_mode") or "manual", "size": _int(a("size")), **{k: a(k) or "" for k in GENESIS}, "created_at": at, "updated_at": at, "last_scanned": at})
        elif op == "move":
            moved = (self.with_id(refs[0]) if refs else None) or self.rows.get(a("from"))
            if moved is not None and a("to") and moved["path"] != a("to"):
                self.drop(moved["path"])
                self.put({**moved, "path": a("to"), "updated_at": at, "last_scanned": at})
        elif strict:
            raise Unapplicable(f"{op_id}: {op}")
        elif op == "gc":
            self._drop_ids(refs)
        elif op == "restore" and row is not None and a("restored_id"):
            g = {k: a(k) or "" for k in GENESIS}
            if genesis_id(g) == a("restored_id").strip().lower():
                self.drop(row["path"])
                self.put({**row, "id": a("restored_id"), **g, "updated_at": at})
        elif op == "sync_mode" and row is not None:
            self.put({**row, "sync_mode": a("to_mode") or row["sync_mode"], "sha256": a("new_sha256") or row["sha256"], "updated_at": at})

    def _drop_ids(self, refs: list[str]) -> None:
        for i in refs:
            if (r := self.with_id(i)) is not None:
                self.drop(r["path"])


def _int(text: str | None) -> int:
    try:
        return int(text or 0)
    except ValueError:
        return 0


def project(wal: DataFrame, strict: bool = False) -> DataFrame:
    """CATALOG as the done operations of each member's log leave it, in the order of seq. wal: member, seq, op_id, op_type, blob_refs, args, created_at, state.

    Paths change owners and ids change paths, so a member's log is read in order; members are independent. Entries stream through, sorted, and a task keeps
    the catalog that results, not the log.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CATALOG))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: Fold | None = None
        for b in batches:
            for member, op_id, op, refs, args, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fold is None or fold.member != member:
                    if fold is not None and fold.rows:
                        yield pa.RecordBatch.from_pylist(list(fold.rows.values()), schema=schema)
                    fold = Fold(member)
                fold.apply(op, dict(args or ()), refs or [], op_id, at, strict)
        if fold is not None and fold.rows:
            yield pa.RecordBatch.from_pylist(list(fold.rows.values()), schema=schema)

    done = wal.where("state = 'done'").select("member", "seq", "op_id", "op_type", "blob_refs", "args", "created_at")
    return done.repartition("member").sortWithinPartitions("member", "seq").drop("seq").mapInArrow(run, CATALOG)


def project_without_moves(wal: DataFrame) -> DataFrame:
    """member, path, sha256 where no operation moves: a path's last ingest or delete decides, and its last content is its. One combining aggregate. wal: member, path, seq, op_type, content_sha256, state."""
    d = wal.where("state = 'done' and op_type in ('ingest', 'delete', 'scan')")
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("seq")))
    g = d.groupBy("member", "path").agg(last("op_type", F.col("op_type") != "scan").alias("kind"), last("content_sha256", F.col("op_type") != "delete").alias("sha256"))
    return g.where("kind = 'ingest'").select("member", "path", "sha256")


def replay(catalog: DataFrame, ops: DataFrame) -> DataFrame:
    """CATALOG after the operations ops (as of project, whatever their state) are applied to catalog in the order of seq, strictly: one that can't be applied fails the run, and nothing is written.

    catalog: CATALOG. A member's catalog is one task's; members without operations pass as they are.
    """
    import pandas as pd

    def run(key: tuple, now: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        member = key[0]
        fold = Fold(member, ({k: None if v is pd.NaT else v for k, v in r.items()} for r in now.to_dict("records")))
        for r in log.sort_values("seq").itertuples(index=False):
            fold.apply(r.op_type, dict(r.args or ()), list(r.blob_refs) if r.blob_refs is not None else [], r.op_id, r.created_at, strict=True)
        out = pd.DataFrame(list(fold.rows.values()), columns=COLUMNS)
        for c in ("created_at", "updated_at", "last_scanned"):
            out[c] = pd.to_datetime(out[c])
        return out.assign(size=out["size"].fillna(0).astype("int64"))

    touched = ops.select("member").distinct()
    some = catalog.join(touched, "member", "left_semi").select(*COLUMNS)
    log = ops.select("member", "seq", "op_id", "op_type", "blob_refs", "args", "created_at")
    done = some.groupBy("member").cogroup(log.groupBy("member")).applyInPandas(run, CATALOG)
    return catalog.join(touched, "member", "left_anti").select(*COLUMNS).unionByName(done)


def upsert(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """catalog with rows in the place of those at their paths."""
    return catalog.join(rows.select("member", "path"), ["member", "path"], "left_anti").unionByName(rows)


def remove(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    return catalog.join(paths.select("member", "path"), ["member", "path"], "left_anti")
