"""Loads: staged tables of one or more scopes replace what a store has of these scopes, all tables in one commit.

A scope whose tables have the digests of its last load is left alone. Of the others, rows whose key is known and whose content is the
same keep the run that last changed them; rows that are no longer staged go. Other scopes stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.store import Store

_OWN = ("row_hash", "first_run", "updated_run")


def row_hash(columns: list[str]):
    """SHA-256 of the columns' texts, each with its length, so that no two rows of unlike values agree; a null has none."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]), 256)


def digests(rows: DataFrame, scope: str, content: list[str]) -> DataFrame:
    """(scope, digest, rows) of each scope's rows, in whatever order they come: from sums of two parts of the rows' hashes."""
    part = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    summed = rows.select(F.col(scope).alias("scope"), row_hash(content).alias("_h")).groupBy("scope").agg(F.count("*").alias("rows"), part(1).alias("a"), part(16).alias("b"))
    return summed.select("scope", F.sha2(F.concat_ws(":", "rows", "a", "b"), 256).alias("digest"), "rows")


def load(store: Store, run: int, tables: dict[str, tuple[DataFrame, list[str]]], scope: str = "repository_id", expected: dict[str, int] | None = None) -> DataFrame:
    """Load tables (name: rows, key), each with the column `scope`; (scope, name, reused, inserted, updated, unchanged, deleted).

    Repeated keys, a null key or scope, and other numbers of rows than expected are errors, raised before anything is written. An
    empty table of a scope that another table names deletes the scope's rows. A failed load leaves the store as it was.
    """
    spark, base = store.spark, store.version()
    live = store.live(base)
    content = {name: sorted(c for c in rows.columns) for name, (rows, _) in tables.items()}
    for name, (rows, key) in tables.items():
        missing = F.lit(False)
        for c in (scope, *key):
            missing = missing | F.col(c).isNull()
        bad = rows.filter(missing).select(F.lit(1)).union(rows.groupBy(scope, *key).count().filter("count > 1").select(F.lit(1)))
        if not bad.isEmpty():
            raise ValueError(f"{name}: a key is null or repeated")
    staged = None
    for name, (rows, _) in tables.items():
        own = digests(rows.withColumn(scope, F.col(scope).cast("string")), scope, content[name]).select(F.lit(name).alias("name"), "scope", "digest", "rows")
        staged = own if staged is None else staged.union(own)
    staged = spark.createDataFrame(staged.collect(), "name string, scope string, digest string, rows long")  # a row for each table and scope
    for name, n in (expected or {}).items():
        if (found := staged.filter(F.col("name") == name).agg(F.sum("rows")).first()[0] or 0) != n:
            raise ValueError(f"{name}: {found} rows are staged, {n} expected")
    scopes = staged.select("scope").distinct()
    before = live.filter(F.col("name").isin(*tables)).join(scopes, "scope", "left_semi")
    new, old = (x.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("name", "digest"))).alias(c)) for x, c in ((staged, "new"), (before, "old")))
    changed = new.join(old, "scope", "left").filter(~F.col("new").eqNullSafe(F.col("old"))).select("scope")
    changed = spark.createDataFrame(changed.collect(), "scope string")
    counts, lines = None, live.join(changed, "scope", "left_anti").union(live.join(changed, "scope", "left_semi").filter(~F.col("name").isin(*tables))).select("name", "scope", "folder", "run", "digest", "rows")
    if not changed.isEmpty():
        for name, (rows, key) in tables.items():
            named = rows.withColumn("_key_scope", F.col(scope).cast("string")).withColumn("row_hash", row_hash(content[name]))
            mine = named.join(changed.select(F.col("scope").alias("_key_scope")), "_key_scope", "left_semi")
            known = store.read(name, base)
            if known is not None:
                ids = [F.col(k).alias(f"_k{n}") for n, k in enumerate(key)]
                past = known.select(F.col(scope).cast("string").alias("_key_scope"), *ids, F.col("row_hash").alias("_h"), F.col("first_run").alias("_first"), F.col("updated_run").alias("_last"))
                mine = mine.withColumns({f"_k{n}": F.col(k) for n, k in enumerate(key)}).join(past, ["_key_scope", *[f"_k{n}" for n in range(len(key))]], "left")
            else:
                mine = mine.withColumns({"_h": F.lit(None).cast("string"), "_first": F.lit(None).cast("long"), "_last": F.lit(None).cast("long")})
            same = F.coalesce(F.col("_h") == F.col("row_hash"), F.lit(False))
            stamped = mine.withColumns({"first_run": F.coalesce("_first", F.lit(run).cast("long")), "updated_run": F.when(same, F.col("_last")).otherwise(F.lit(run).cast("long"))})
            folder = store.write(stamped.select(*rows.columns, *_OWN, "_key_scope"), "_key_scope")
            n = lambda on: F.count_if(on)
            first, last = F.col("first_run") == run, F.col("updated_run") == run
            written = spark.read.parquet(f"{store.root}/data/{folder}").groupBy(F.col("_key_scope").alias("scope")).agg(n(first).alias("inserted"), n(last & ~first).alias("updated"), n(~last).alias("unchanged"))
            had = before.filter(F.col("name") == name).select("scope", F.col("rows").alias("had"))
            count = changed.join(written, "scope", "left").join(had, "scope", "left").na.fill(0).filter("inserted + updated + unchanged + had > 0")
            count = count.select("scope", F.lit(name).alias("name"), F.lit(False).alias("reused"), "inserted", "updated", "unchanged", (F.col("had") - F.col("updated") - F.col("unchanged")).alias("deleted"))
            counts = count if counts is None else counts.union(count)
            line = staged.filter(F.col("name") == name).join(changed, "scope", "left_semi")
            lines = lines.union(line.select("name", "scope", F.lit(folder), F.lit(run).cast("long"), "digest", "rows"))
        store.commit(lines, base)
    zero = [F.lit(0).cast("long").alias(c) for c in ("inserted", "updated")]
    reused = before.join(changed, "scope", "left_anti").select("scope", "name", F.lit(True).alias("reused"), *zero, F.col("rows").alias("unchanged"), F.lit(0).cast("long").alias("deleted"))
    return reused if counts is None else reused.union(counts)
