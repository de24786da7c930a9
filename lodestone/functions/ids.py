"""Identity: NUL-terminated sha256 ids, citations, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def stable_id(*parts: str | Column) -> Column:
    """sha256 over each part followed by a NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in ((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(NUL))]), 256)


def citation(project, branch, commit, path, first, last) -> Column:
    """project branch@commit path:Lfirst-Llast."""
    return F.concat(project, F.lit(" "), F.coalesce(branch, F.lit("?")), F.lit("@"), F.substring(commit, 1, 12), F.lit(" "), path, F.lit(":L"), first, F.lit("-L"), last)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def tied(x: Column, digits: int = 6) -> Column:
    """x on a grid, by the same arithmetic in every engine."""
    return F.floor(x * 10**digits + 0.5) / F.lit(float(10**digits))


def canonical_branch(ref: Column) -> Column:
    """A branch's name without the prefixes of its references."""
    return F.regexp_replace(F.trim(ref), "^(refs/remotes/origin/|refs/heads/|origin/)", "")


def catalog_path(branch: Column) -> Column:
    """The catalog file of a branch: its parts as safe names, with eight digits of a digest where they had to change."""

    def part(x: Column) -> Column:
        safe = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
        safe = F.when(safe == "", "branch").otherwise(safe)
        return F.when(safe == x, x).otherwise(F.concat(safe, F.lit("--"), F.substring(F.sha2(x, 256), 1, 8)))

    return F.concat(F.lit("branches/"), F.array_join(F.transform(F.split(branch, "/"), part), "/"), F.lit(".generated.yaml"))
