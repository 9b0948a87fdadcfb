"""Identities: canonical bytes, file ids, operation ids, path ids, pointers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = ("content_sha256", "original_path", "ingest_op_id", "origin_node")
#: Escapes of the canonical text form, by character.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
ESCAPES |= {chr(c): f"\\u{c:04X}" for c in [*range(32), 127] if chr(c) not in ESCAPES}


def escaped(text: Column) -> Column:
    """text as the inside of a quoted string of the canonical form."""
    return reduce(lambda out, c: F.replace(out, F.lit(c), F.lit(ESCAPES[c])), ESCAPES, text)


def line(key: str | Column, value: Column) -> Column:
    return F.concat(F.lit(key) if isinstance(key, str) else key, F.lit(' = "'), escaped(value), F.lit('"\n'))


def genesis_bytes(genesis: dict[str, Column]) -> Column:
    """The four lines whose hash is a file's id."""
    return F.concat(*[line(k, genesis[k]) for k in GENESIS])


def mint_id(genesis: dict[str, Column]) -> Column:
    return F.sha2(genesis_bytes(genesis), 256)


def certifies(genesis: dict[str, Column], ident: Column) -> Column:
    return F.coalesce(mint_id(genesis) == F.lower(F.trim(ident)), F.lit(False))


def genesis_problem(genesis: dict[str, Column]) -> Column:
    """What is wrong with a birth record; null if nothing is."""
    c = genesis
    return F.when(~F.coalesce(c["content_sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "content_sha256").when(F.coalesce(c["original_path"], F.lit("")) == "", "original_path").when(F.coalesce(c["ingest_op_id"], F.lit("")) == "", "ingest_op_id").when(F.coalesce(c["origin_node"], F.lit("")) == "", "origin_node")


def guarded_id(genesis: dict[str, Column]) -> Column:
    """Struct of id and problem: the record's id where the record is whole, else what is wrong with it."""
    bad = genesis_problem(genesis)
    return F.struct(F.when(bad.isNull(), mint_id(genesis)).alias("id"), bad.alias("problem"))


def op_id(*parts: Column) -> Column:
    """An operation's id from its parts: 16 bytes of their hash, marked as a version 4 UUID, as 32 hex digits."""
    h = F.sha2(F.concat_ws("\x00", *parts), 256)
    return F.concat(F.substring(h, 1, 12), F.lit("4"), F.substring(h, 14, 3), F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), F.substring(h, 18, 15))


def clean_path(path: Column) -> Column:
    """path without empty and . segments, each .. taken with the segment before it; of a rooted path none leads above the root. Nothing left: `.` or `/`."""
    rooted = path.startswith("/")

    def step(out: Column, seg: Column) -> Column:
        up = F.when((F.size(out) > 0) & (F.element_at(F.concat(F.array(F.lit("")), out), -1) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(rooted, out).otherwise(F.concat(out, F.array(seg)))
        return F.when(seg.isin("", "."), out).when(seg == "..", up).otherwise(F.concat(out, F.array(seg)))

    segs = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(rooted, F.concat(F.lit("/"), F.array_join(segs, "/"))).when(F.size(segs) == 0, ".").otherwise(F.array_join(segs, "/"))


def path_id(path: Column) -> Column:
    return F.sha2(clean_path(path), 256)


def pointer_text(sha256: Column, size: Column, location: Column, magic: str) -> Column:
    """The four lines that stand for a file's content in a working tree."""
    return F.concat(F.lit(f"{magic}\nsha256 "), sha256, F.lit("\nsize "), size.cast("string"), F.lit("\nlocation "), location, F.lit("\n"))


def is_pointer(content: Column, magic: str) -> Column:
    return content.startswith(f"{magic}\n") | (F.regexp_replace(content, r"\n+$", "") == magic)


def pointer(content: Column, magic: str) -> Column:
    """Struct of sha256, size and location of a pointer's text; null unless each line is as pointer_text writes it."""
    rx = rf"^\Q{magic}\E\nsha256 ([0-9a-f]+)\nsize ([0-9]{{1,18}})\nlocation ([^\n]*\S[^\n]*)\n?$"
    return F.when(content.rlike(rx), F.struct(F.regexp_extract(content, rx, 1).alias("sha256"), F.regexp_extract(content, rx, 2).cast("long").alias("size"), F.regexp_extract(content, rx, 3).alias("location")))


def wal_parts(e: dict[str, Column]) -> tuple[Column, Column]:
    """A log entry's canonical text before and after the line of prev_hash. created_at: the text of its time, as it was written; args: a map, its keys in byte order."""
    refs = F.array_join(F.transform(e["blob_refs"], lambda r: F.concat(F.lit('"'), escaped(r), F.lit('"'))), ", ")
    args = F.array_join(F.transform(F.array_sort(F.map_keys(e["args"])), lambda k: line(k, F.element_at(e["args"], k))), "")
    front = F.concat(F.lit("seq = "), e["seq"].cast("string"), F.lit("\n"), line("op_id", e["op_id"]))
    back = F.concat(line("op_type", e["op_type"]), F.lit("blob_refs = ["), refs, F.lit("]\n"), line("actor", e["actor"]), F.lit("created_at = "), e["created_at"], F.lit("\n"))
    return front, F.concat(back, F.when(F.coalesce(F.cardinality(e["args"]), F.lit(0)) > 0, F.concat(F.lit("\n[args]\n"), args)).otherwise(""))


def wal_text(e: dict[str, Column]) -> Column:
    front, back = wal_parts(e)
    return F.concat(front, line("prev_hash", e["prev_hash"]), back)
