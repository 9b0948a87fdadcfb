"""Sinks. Each writes through Spark's commit protocol: a run that fails leaves what was there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacat.functions import identity, scalars


def replace_table(df: DataFrame, path: str, order: str = "path") -> str:
    """df as the new content of a table that it may be read from: written whole beside it, as path/v-<id>, and then named in path/_current by one rename. Returns the folder. A run that fails leaves the old one; read with current_table."""
    from uuid import uuid4

    from stratacat.sources.files import _store

    name = f"v-{uuid4().hex}"
    write_table(df, f"{path}/{name}", order)
    store, at = _store(path)
    with store.open_output_stream(f"{at}/_{name}") as f:
        f.write(name.encode())
    store.move(f"{at}/_{name}", f"{at}/_current")
    return f"{path}/{name}"


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """What replace_table wrote last."""
    from stratacat.sources.files import _store

    store, at = _store(path)
    with store.open_input_stream(f"{at}/_current") as f:
        return spark.read.parquet(f"{path}/{f.read().decode()}")


def write_table(df: DataFrame, path: str, order: str = "path") -> None:
    """df in canonical order, as a new table at path. Ranges of the order are written side by side; equal tables have equal rows."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)


def put_new(objects: DataFrame, there: DataFrame, path: str) -> None:
    """Adds the objects whose key there doesn't have; a second run adds nothing."""
    objects.join(there.select("object_key"), "object_key", "left_anti").write.mode("append").parquet(path)


def put_over(there: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """The table of mutable keys with new rows in the place of those of their keys: the last write counts. Write it with replace_table."""
    return there.join(new.select(key), key, "left_anti").unionByName(new)


def delete_keys(there: DataFrame, gone: DataFrame, key: str = "key") -> DataFrame:
    """The table without the keys gone; keys that it doesn't have are fine."""
    return there.join(gone.select(key).distinct(), key, "left_anti")


def refs_table(there: DataFrame, lists: DataFrame) -> DataFrame:
    """path_id, pos, sha256 of version lists with those of lists (path_id, versions: newest first) in the place of theirs; an empty list leaves none."""
    new = lists.select("path_id", F.posexplode("versions").alias("pos", "sha256"))
    return there.join(lists.select("path_id"), "path_id", "left_anti").unionByName(new.select(*there.columns))


def refs_text(refs: DataFrame) -> DataFrame:
    """path_id, text: a path's version list as it is stored, a line each, newest first."""
    return refs.groupBy("path_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sha256"))), lambda x: F.concat(x["sha256"], F.lit("\n"))), "").alias("text"))


def append_markers(markers: DataFrame, there: DataFrame, path: str) -> None:
    """Adds member, seq, mark rows that there doesn't have."""
    markers.join(there.select("member", "seq", "mark"), ["member", "seq", "mark"], "left_anti").write.mode("append").parquet(path)


def receipts_table(there: DataFrame, receipts: DataFrame) -> DataFrame:
    """The table of receipts with certified new ones in the place of those of their ids. Write it with replace_table."""
    g = {k: F.col(f"genesis.{k}") for k in identity.GENESIS}
    return put_over(there, receipts.where(identity.certifies(g, F.col("id"))), "id")


def write_receipts(receipts: DataFrame, there: DataFrame, path: str) -> None:
    """receipts_table as the current version of the table at path, which there may be read from."""
    replace_table(receipts_table(there, receipts), path, "id")


def write_wal_files(wal: DataFrame, path: str) -> None:
    """name, text of entries as rows of a text table, one partition a member. wal: as identity.wal_text takes it."""
    e = {c: F.col(c) for c in ("seq", "op_id", "prev_hash", "op_type", "blob_refs", "actor", "created_at", "args")}
    wal.select("member", scalars.entry_name(F.col("seq")).alias("name"), identity.wal_text(e).alias("text")).write.mode("overwrite").partitionBy("member").json(path)


def _inline(genesis: str) -> Column:
    """A birth record as an inline table."""
    f = lambda k: F.concat(F.lit(f'{k} = "'), identity.escaped(F.col(f"{genesis}.{k}")), F.lit('"'))
    return F.concat(F.lit(f"{genesis} = {{"), F.concat_ws(", ", *[f(k) for k in identity.GENESIS]), F.lit("}\n"))


def _bool(key: str) -> Column:
    return F.concat(F.lit(f"{key} = "), F.coalesce(key, F.lit(False)).cast("string"), F.lit("\n"))


def lock_text(lock: DataFrame) -> DataFrame:
    """path, text: each entry as it stands in a lock document; in the order of path they make the document. lock: path, sha256, size, location, history, preserve, deleted, and of id, genesis, pushed_at, pusher and versions what it has.

    id and record stand only where there is one, deleted only where it is true, versions only for entries with history.
    """
    q = lambda k: identity.line(k, F.coalesce(F.col(k), F.lit("")))
    has = lambda k: k in lock.columns
    parts = [F.lit("[[entry]]\n"), q("path")]
    parts += [F.when(F.coalesce("id", F.lit("")) != "", q("id")).otherwise("")] if has("id") else []
    parts += [F.when(F.col("genesis").isNotNull(), _inline("genesis")).otherwise("")] if has("genesis") else []
    parts += [q("sha256"), F.lit("size = "), F.col("size").cast("string"), F.lit("\n"), q("location")]
    parts += [F.when(F.col("pushed_at").isNotNull(), F.concat(F.lit("pushed_at = "), scalars.rfc3339(F.col("pushed_at")), F.lit("\n"))).otherwise("")] if has("pushed_at") else []
    parts += [q("pusher")] if has("pusher") else []
    parts += [_bool("history"), _bool("preserve"), F.when(F.col("deleted"), F.lit("deleted = true\n")).otherwise("")]
    if has("versions"):
        rows = F.array_join(F.transform("versions", lambda v: F.concat(F.lit('"'), identity.escaped(v), F.lit('"'))), ", ")
        parts += [F.when(F.col("history") & (F.size("versions") > 0), F.concat(F.lit("versions = ["), rows, F.lit("]\n"))).otherwise("")]
    return lock.select("path", F.concat(*parts).alias("text"))


def catalog_text(catalog: DataFrame) -> DataFrame:
    """member, path, text: each file as it stands in its member's catalog document, in the order of path. catalog: schemas.CATALOG."""
    q = lambda k: identity.line(k, F.coalesce(F.col(k), F.lit("")))
    at = lambda k: F.concat(F.lit(f"{k} = "), scalars.rfc3339(F.col(k)), F.lit("\n"))
    when = [F.when(F.col(k).isNotNull(), at(k)).otherwise("") for k in ("created_at", "updated_at", "last_scanned")]
    return catalog.select("member", "path", F.concat(F.lit("[[file]]\n"), q("id"), _inline("genesis"), q("sha256"), q("path"), q("sync_mode"), F.lit("size = "), F.col("size").cast("string"), F.lit("\n"), *when).alias("text"))


def document_head(kind: str, **fields: str) -> str:
    """The lines that a document starts with: its version and the given texts."""
    from stratacat import schemas

    quoted = {k: "".join(identity.ESCAPES.get(c, c) for c in v) for k, v in fields.items()}
    return "".join([f"version = {schemas.VERSIONS[kind]}\n", *(f'{k} = "{v}"\n' for k, v in quoted.items())])


def config_text(rules: dict, location: str = "") -> str:
    """A config document of rules as sources.files.config reads it: what equals the default stands too, so that later defaults change nothing."""
    import json

    def value(v: object) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else json.dumps(v)

    out = [document_head("config", **({"location": location} if location else {})), "\n[rules]\n"]
    out += [f"{k} = {value(v)}\n" for k, v in rules.items() if k != "override"]
    for o in rules.get("override", []):
        out += ["\n[[rules.override]]\n", *(f"{k} = {value(v)}\n" for k, v in o.items() if v is not None)]
    return "".join(out)


def locations_text(locations: DataFrame) -> DataFrame:
    """name, text of a registry's locations; in the order of name they make the document."""
    fields = [c for c in locations.columns if c != "name"]
    rows = [F.when(F.coalesce(c, F.lit("")) != "", identity.line(c, F.col(c))).otherwise("") for c in fields]
    return locations.select("name", F.concat(F.lit('[locations."'), identity.escaped(F.col("name")), F.lit('"]\n'), *rows).alias("text"))


def registry_add(locations: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new rows in the place of those of their names; a row that isn't a whole location is an error, and nothing is added."""
    from stratacat import schemas

    bad = schemas.location_problems(new).orderBy("name").limit(3).collect()
    if bad:
        raise ValueError("; ".join(f"{r['name']}: {r['problem']}" for r in bad))
    return put_over(locations, new.select(*locations.columns), "name")


def registry_remove(locations: DataFrame, name: str) -> DataFrame:
    """The registry without a name; one that it doesn't have is an error."""
    if not locations.where(F.col("name") == name).take(1):
        raise LookupError(f"no location {name}")
    return locations.where(F.col("name") != name)


def aligned(df: DataFrame, *keys: str) -> DataFrame:
    """text: the rows as a table of aligned columns under a line of their names, in the order of keys; each column as wide as its longest value. Two passes: widths, one row, and the lines."""
    cols = df.columns
    d = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])
    wide = d.agg(*[F.greatest(F.coalesce(F.max(F.length(c)), F.lit(0)), F.lit(len(c))).alias(f"__{c}") for c in cols])
    pad = lambda c, v: F.rpad(v, F.col(f"__{c}"), F.lit(" "))
    line = lambda of: F.rtrim(F.concat_ws("  ", *[pad(c, of(c)) for c in cols]))
    body = d.join(wide, F.lit(True)).select(F.lit(1).alias("__part"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], line(lambda c: F.col(c)).alias("text"))  # one row on the right
    head = wide.select(F.lit(0).alias("__part"), *[F.lit(None).cast("string").alias(f"__k{i}") for i in range(len(keys))], line(lambda c: F.lit(c.upper())).alias("text"))
    return head.unionByName(body).orderBy("__part", *[f"__k{i}" for i in range(len(keys))]).select("text")


def to_json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
