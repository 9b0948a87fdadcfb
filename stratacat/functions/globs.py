"""Path globs, compiled to regular expressions; rules and ignore lists made of them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadGlob(ValueError):
    """A glob that can't be read."""


def to_regex(glob: str) -> str:
    """Anchored at both ends. * and ? stop at /; ** as a whole segment crosses any number of them; [..] and {a,b} as usual; a/** doesn't match a itself."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] in "/{,"):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise BadGlob(f"{glob}: [ has no end")
            inner = glob[i + 1 : end]
            no = inner[:1] in ("!", "^")
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", inner[no:])
            out.append(f"[^/{inner}]" if no else f"[{inner}]")
            i = end + 1
        elif c == "{":
            out.append("(?:")
            depth, i = depth + 1, i + 1
        elif c == "}" and depth:
            out.append(")")
            depth, i = depth - 1, i + 1
        elif c == "," and depth:
            out.append("|")
            i += 1
        elif c == "\\":
            if i + 1 == len(glob):
                raise BadGlob(f"{glob}: nothing follows the last backslash")
            out.append(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", glob[i + 1]))
            i += 2
        else:
            out.append(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", c))
            i += 1
    if depth:
        raise BadGlob(f"{glob}: {{ has no end")
    try:
        re.compile(made := f"^{''.join(out)}$")
    except re.error as e:  # a range that runs backwards
        raise BadGlob(f"{glob}: {e}") from e
    return made


def has_meta(text: Column) -> Column:
    return text.rlike(r"[*?\[{]")


def any_match(globs: Sequence[str], path: Column) -> Column:
    return reduce(lambda a, g: a | path.rlike(to_regex(g)), globs, F.lit(False))


def evaluate(path: Column, size: Column, min_size: int, include: Sequence[str], exclude: Sequence[str], history: bool, overrides: Sequence[tuple[str, bool | None, bool | None]]) -> Column:
    """Struct of managed, history and preserve. Managed: large enough or included, and not excluded. The first override that matches a managed path sets the flags that it names."""
    managed = ((size >= min_size) | any_match(include, path)) & ~any_match(exclude, path)
    h, p = F.lit(history), F.lit(False)
    for glob, own_h, own_p in reversed(overrides):
        hit = path.rlike(to_regex(glob))
        h = F.when(hit, F.lit(history if own_h is None else own_h)).otherwise(h)
        p = F.when(hit, F.lit(bool(own_p))).otherwise(p)
    return F.struct(managed.alias("managed"), F.when(managed, h).otherwise(history).alias("history"), F.when(managed, p).otherwise(False).alias("preserve"))


def first_override(path: Column, globs: Sequence[str]) -> Column:
    """The number, from 0, of the first glob that matches; null if none does."""
    return reduce(lambda out, g: F.when(path.rlike(to_regex(g[1])), g[0]).otherwise(out), reversed(list(enumerate(globs))), F.lit(None).cast("int"))


def parse_ignore(text: str) -> list[tuple[str, bool]]:
    """(glob, negated) in order: blank lines and those that start with # don't count, ! takes back, a leading / is dropped; `dir/` is the directory and all below, a bare name stands at any depth."""
    out = []
    for raw in text.splitlines():
        row = raw.strip()
        if not row or row.startswith("#"):
            continue
        negated, row = row.startswith("!"), row.removeprefix("!").removeprefix("/")
        globs = [row[:-1], f"{row[:-1]}/**"] if row.endswith("/") else [row, f"**/{row}"] if "/" not in row else [row]
        for g in globs:
            to_regex(g)
            out.append((g, negated))
    return out


def ignored(path: Column, patterns: Sequence[tuple[str, bool]], explicit: Column | None = None) -> Column:
    """Whether the last pattern that matches says so; paths that are tracked by name never are."""
    hit = reduce(lambda out, p: F.when(path.rlike(to_regex(p[0])), not p[1]).otherwise(out), patterns, F.lit(False))
    return hit if explicit is None else hit & ~explicit


def reserved(key: Column, names: Sequence[str] = ("meta", "objects", "refs")) -> Column:
    return F.substring_index(key, "/", 1).isin(*names)
