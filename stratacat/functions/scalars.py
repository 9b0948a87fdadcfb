"""Scalar functions, as Columns that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX64 = "^[0-9a-f]{64}$"
#: Binary units of sizes, by their first letter.
UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_size(text: Column) -> Column:
    """Bytes of a size like 5MB, 1.5 GiB, 100B or 1048576; null if it isn't one. Units are binary, case and inner space don't matter, fractions are cut off."""
    s = F.upper(F.trim(text))
    number, unit = F.regexp_extract(s, r"^([0-9]*\.?[0-9]+)\s*([KMGT]?)(?:I?B)$", 1), F.regexp_extract(s, r"^([0-9]*\.?[0-9]+)\s*([KMGT]?)(?:I?B)$", 2)
    factor = reduce(lambda out, u: F.when(unit == u, F.lit(UNITS[u])).otherwise(out), UNITS, F.lit(None).cast("long"))
    bare = s.rlike(r"^[+-]?[0-9]+$")
    return F.when(bare, s.try_cast("long")).when(number != "", F.floor(number.try_cast("double") * factor).cast("long"))


def human_bytes(n: Column) -> Column:
    """1536 -> 1.5 KiB."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, u in enumerate("KMGT"):
        out = F.when(n >= 1 << 10 * (i + 1), F.format_string(f"%.1f {u}iB", n / float(1 << 10 * (i + 1)))).otherwise(out)
    return out


def age_text(seconds: Column) -> Column:
    """Whole seconds, minutes, hours or days; what lies ahead is 0s."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    of = lambda k, u: F.concat(F.floor(s / k).cast("string"), F.lit(u))
    return F.when(s < 60, of(1, "s")).when(s < 3600, of(60, "m")).when(s < 86400, of(3600, "h")).otherwise(of(86400, "d"))


def short(ident: Column) -> Column:
    return F.substring(ident, 1, 12)


def is_hex64(text: Column) -> Column:
    return text.rlike(HEX64)


def semver(text: Column) -> Column:
    """Struct of major, minor, patch; null if text isn't a version. A leading v and what follows - or + don't count."""
    s = F.regexp_replace(F.trim(text), r"^v", "")
    rx = r"^([0-9]+)\.([0-9]+)\.([0-9]+)(?:[-+].*)?$"
    return F.when(s.rlike(rx), F.struct(*[F.regexp_extract(s, rx, i + 1).cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def newer(current: Column, latest: Column) -> Column:
    """Whether latest is a higher version; false if either is none."""
    return F.coalesce(semver(current) < semver(latest), F.lit(False))


def split_lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def target(text: Column) -> Column:
    """Struct of id (lower case, 12 hex digits or more, no slash) or member and path of `member/path`; all null for neither."""
    is_id = text.rlike("^[0-9a-fA-F]{12,64}$")
    at = F.instr(text, "/")
    pair = (at > 1) & (at < F.length(text))
    return F.struct(F.when(is_id, F.lower(text)).alias("id"), F.when(~is_id & pair, F.substring_index(text, "/", 1)).alias("member"), F.when(~is_id & pair, F.substr(text, at + 1)).alias("path"))


def entry_name(seq: Column) -> Column:
    return F.concat(F.lpad(seq.cast("string"), 12, "0"), F.lit(".toml"))


def seq_of_marker(name: Column, suffix: str) -> Column:
    """The number in a marker's name of twelve digits; null for other names."""
    return F.when(name.rlike(rf"^[0-9]{{12}}\.{suffix}$"), F.substring(name, 1, 12).cast("long"))


def status_rank(status: Column) -> Column:
    return F.when(status == "evicted", 2).when(status == "left", 1).otherwise(0)


def exit_code(outcome: Column) -> Column:
    """Of a resolution: 0 found, 5 missing, 6 for what can't be known, 1 for an error."""
    return F.when(outcome.isin("found-at-home", "found-elsewhere"), 0).when(outcome == "missing", 5).when(outcome == "partial-view", 6).otherwise(1)


def trim_dot(name: Column) -> Column:
    return F.regexp_replace(name, r"\.$", "")


def digest_of(line: Column) -> Column:
    """The leading SHA-256 of a checksum line; null if there is none."""
    return F.nullif(F.regexp_extract(line, r"^\s*([0-9a-f]{64})(?:\s|$)", 1), F.lit(""))


def checksum_for(sums: Column, name: Column) -> Column:
    """The digest that the lines of a checksum file give for a name."""
    rows = F.filter(F.split(sums, "\n"), lambda x: F.regexp_replace(F.element_at(F.split(F.trim(x), r"\s+"), -1), r"^\*", "") == name)
    return digest_of(F.get(rows, F.lit(0)))


def sync_mode(mode: Column) -> Column:
    return F.coalesce(F.nullif(mode, F.lit("")), F.lit("manual"))


def freshness(recorded: Column, found: Column) -> Column:
    return F.when(recorded == found, "verified").otherwise("changed-since-scan")


def random_op_id() -> Column:
    """A new random operation id: 32 hex digits of a version 4 UUID."""
    return F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))


#: Exit codes by kind of error: preconditions 2, network 3, a member's machine 4, content 5, federation 6.
EXIT_CODES = {"network-down": 3, "logged-out": 3, "node-offline": 4, "node-not-writable": 4, "object-missing": 5, "auth-required": 2, "config": 2, "partial-view": 6, "need-all-members": 6, "chain-broken": 6, "id-collision": 6}


def exit_of(kind: Column) -> Column:
    """0 for no error, the code of a named kind, 1 for an unexpected one."""
    out = F.lit(1)
    for k, v in EXIT_CODES.items():
        out = F.when(kind == k, v).otherwise(out)
    return F.when(kind.isNull(), 0).otherwise(out)


def rfc3339(at: Column) -> Column:
    """A time in UTC to the second, 2024-01-01T00:00:00Z; empty for none."""
    return F.coalesce(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def conflict_mode(answer: Column) -> Column:
    """copy, rename or stop from an answer's word or first letter; anything else stops."""
    a = F.lower(F.trim(answer))
    return F.when(a.isin("c", "copy"), "copy").when(a.isin("r", "rename"), "rename").otherwise("stop")


def is_yes(answer: Column) -> Column:
    return F.coalesce(F.lower(F.trim(answer)).isin("y", "yes"), F.lit(False))


def status_verb(status: Column) -> Column:
    return F.when(status == "evicted", "was evicted from").when(status == "left", "left").otherwise("is no longer active in")


def member_names(names: Column) -> Column:
    """Names joined by commas; an empty list is an unknown member."""
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("an unknown member")


def pusher(network: Column, email: Column) -> Column:
    """Who pushes: the network's name unless it is empty or a bare @, else the e-mail, else unknown."""
    return F.coalesce(F.nullif(F.nullif(network, F.lit("")), F.lit("@")), F.nullif(email, F.lit("")), F.lit("unknown"))


def actor(network: Column, email: Column) -> Column:
    """Who acts, for a log entry: as pusher, but a bare @ stands."""
    return F.coalesce(F.nullif(network, F.lit("")), F.nullif(email, F.lit("")), F.lit("unknown"))


def with_include(include: Column, pattern: Column) -> Column:
    """include with pattern at its end unless it has it."""
    return F.when(F.array_contains(include, pattern), include).otherwise(F.array_append(include, pattern))


def with_lines(text: Column, wanted: Column) -> Column:
    """text with those lines of the array wanted that it doesn't have, trimmed, added in order; a last line without an end gets one first."""
    have = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    new = F.filter(F.array_distinct(F.transform(wanted, lambda x: F.trim(x))), lambda w: (w != "") & ~F.array_contains(have, w))
    end = F.when((text != "") & ~text.endswith("\n"), "\n").otherwise("")
    return F.when(F.size(new) > 0, F.concat(text, end, F.array_join(new, "\n"), F.lit("\n"))).otherwise(text)


def track_mode(args: Column, force_vault: Column, force_repo: Column, registered: Column, in_repo: Column) -> Column:
    """vault, repo or the error of the arguments of a track: both-flags or ambiguous. registered: whether the one argument's first segment names a location."""
    one = (F.size(args) == 1) & F.contains(F.get(args, F.lit(0)), F.lit("/")) & registered
    return F.when(force_vault & force_repo, "both-flags").when(force_vault, "vault").when(force_repo | ~F.coalesce(one, F.lit(False)), "repo").when(in_repo, "ambiguous").otherwise("vault")
