"""Schemas of the tables, their versions and the queries that find rows which break them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacat.functions.identity import GENESIS, certifies, genesis_problem

_GENESIS = "struct<content_sha256: string, original_path: string, ingest_op_id: string, origin_node: string>"
VERSIONS = {"lock": 2, "catalog": 2, "config": 1}
LOCK = f"branch string, path string, id string, genesis {_GENESIS}, sha256 string, size bigint, location string, pushed_at timestamp, pusher string, history boolean, preserve boolean, deleted boolean, versions array<string>"
CATALOG = f"member string, id string, genesis {_GENESIS}, sha256 string, path string, sync_mode string, size bigint, created_at timestamp, updated_at timestamp, last_scanned timestamp"
WAL = "member string, seq bigint, op_id string, prev_hash string, op_type string, blob_refs array<string>, actor string, created_at timestamp, args map<string,string>, self_hash string, state string"
ROSTER = "observer string, fed_id string, name string, node string, joined_at timestamp, status string"
RECEIPT = f"id string, genesis {_GENESIS}, path string, sha256_at_pull string, pulled_at timestamp, source_node string"
OBJECTS = "member string, object_key string, size bigint, observed_sha string"
TREE = "path string, sha256 string, size bigint, mtime timestamp"
SNAPSHOT = "fed_id string, generation int, taken_at timestamp, name string, node string, status string, reachable boolean, last_seen timestamp, file_count int, ids array<string>"
LOCATIONS = "name string, node string, base_path string, backend string, user string, share string"


def _genesis(col: str) -> dict[str, Column]:
    return {k: F.col(f"{col}.{k}") for k in GENESIS}


def lock_problems(lock: DataFrame) -> DataFrame:
    """path, problem: an id without a birth record or the other way round, or an id that isn't its record's hash. An empty id is none."""
    has_id, g = F.coalesce(F.col("id"), F.lit("")) != "", F.col("genesis").isNotNull()
    bad = F.when(has_id & ~g, "id-without-genesis").when(~has_id & g, "genesis-without-id").when(has_id & g & genesis_problem(_genesis("genesis")).isNotNull(), "genesis-incomplete").when(has_id & g & ~certifies(_genesis("genesis"), F.col("id")), "id-mismatch")
    return lock.select("path", bad.alias("problem")).where("problem is not null")


def catalog_problems(catalog: DataFrame) -> DataFrame:
    bad = F.when(F.coalesce(F.col("path"), F.lit("")) == "", "path").when(~F.coalesce(F.col("id").rlike("^[0-9a-f]{64}$"), F.lit(False)), "id")
    return catalog.select("member", "path", "id", bad.alias("problem")).where("problem is not null")


def location_problems(locations: DataFrame) -> DataFrame:
    """name, problem: the field that a location of its backend lacks or, for local, has though it shouldn't."""
    lacks = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    b = F.col("backend")
    bad = (
        F.when(lacks("base_path"), "base_path")
        .when(lacks("backend") | ~b.isin("local", "ssh", "share"), "backend")
        .when((b == "local") & ~(lacks("node") & lacks("user") & lacks("share")), "local-takes-only-base_path")
        .when((b != "local") & lacks("node"), "node")
        .when((b == "ssh") & lacks("user"), "user")
        .when((b == "share") & lacks("share"), "share")
    )
    return locations.select("name", bad.alias("problem")).where("problem is not null")
