"""Sections and windows of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CHARS, OVERLAP = 3500, 5


def lines_of(text: Column) -> Column:
    """Lines as str.splitlines gives them: many separators, and no empty last line."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def window_ranges(lines: Column, most: int = MOST_CHARS, overlap: int = OVERLAP) -> Column:
    """(s, e) ranges of lines, end exclusive: as many lines as fit into `most` characters, cut after the last blank line, overlapping."""
    lengths = F.transform(lines, lambda x: F.length(x) + 1)
    cum = F.aggregate(lengths, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    body = """
    transform(array(named_struct('lines', lines, 'cum', cum)), z -> aggregate(sequence(1, greatest(size(z.lines), 1)),
      named_struct('cur', 0, 'done', size(z.lines) = 0, 'r', cast(array() as array<struct<s:int,e:int>>)),
      (st, i) -> if(st.done, st,
        transform(array(greatest(st.cur + 1, cast(size(filter(z.cum, (c, j) -> j <= st.cur or c - z.cum[st.cur] <= {most})) - 1 as int))), lim0 ->
          transform(array(if(lim0 >= size(z.lines), lim0, coalesce(array_max(filter(sequence(st.cur + 1, lim0), k -> trim(z.lines[k - 1]) = '')), lim0))), lim ->
            named_struct('cur', greatest(st.cur + 1, lim - {overlap}), 'done', lim >= size(z.lines),
              'r', concat(st.r, array(named_struct('s', st.cur, 'e', lim)))))[0])[0])).r)[0]
    """
    return lines, cum, body.format(most=most, overlap=overlap)


def chunk_windows(docs: DataFrame, most: int = MOST_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, window, line_start, line_end (from 1, inclusive), text (trimmed), chunk_hash; windows without text are left out."""
    lines, cum, ranges = window_ranges(F.col("lines"), most, overlap)
    d = docs.select("doc_id", lines_of(F.col("text")).alias("lines")).withColumn("cum", cum)
    d = d.withColumn("ranges", F.expr(ranges)).select("doc_id", "lines", F.posexplode("ranges").alias("win", "x"))
    text = F.regexp_replace(F.array_join(F.slice("lines", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")), "\n"), r"^\s+|\s+$", "")
    d = d.select("doc_id", "win", (F.col("x.s") + 1).alias("line_start"), F.col("x.e").alias("line_end"), text.alias("text"))
    return d.filter("text <> ''").withColumn("chunk_hash", F.concat(F.lit("sha256:"), F.sha2("text", 256)))


def heading_sections(docs: DataFrame) -> DataFrame:
    """Markdown sections: doc_id, line_start, line_end, title (the headings above, joined). Text before the first heading is a section without title."""
    rows = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("p", "x"))
    rows = rows.withColumn("level", F.length(F.regexp_extract("x", r"^(#{1,6})\s+\S", 1)))
    by, w = Window.partitionBy("doc_id").orderBy("p"), Window.partitionBy("doc_id")
    total = rows.groupBy("doc_id").agg(F.max("p").alias("_last"))
    heads = rows.filter("level > 0").select("doc_id", "p", "level", F.trim(F.regexp_replace("x", r"^#{1,6}\s+", "")).alias("name"))
    step = lambda a, x: F.concat(F.slice(a, 1, F.least(F.size(a), x["level"] - 1)), F.array(x["name"]))
    trail = F.collect_list(F.struct("level", "name")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    heads = heads.withColumns({"title": F.array_join(F.aggregate(trail, F.expr("cast(array() as array<string>)"), step), " / "), "_next": F.lead("p").over(by)})
    first = rows.filter("level = 0").select("doc_id", "p").join(heads.groupBy("doc_id").agg(F.min("p").alias("_first")), "doc_id", "left").filter("_first is null or p < _first")
    before = first.groupBy("doc_id").agg(F.min("p").alias("p"), F.first("_first").alias("_next")).withColumn("title", F.lit(""))
    both = heads.select("doc_id", "p", "_next", "title").unionByName(before.select("doc_id", "p", "_next", "title"))
    return both.join(total, "doc_id").select("doc_id", (F.col("p") + 1).alias("line_start"), F.coalesce("_next", F.col("_last") + 1).alias("line_end"), "title")
