"""Text functions of retrieval and auditing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences_of(needle: str, haystack: Column) -> Column:
    """How often needle occurs in haystack, without overlaps."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle)).cast("double")


def leaf_name(qualified: Column) -> Column:
    return F.trim(F.substring_index(qualified, "::", -1))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LITERAL = r'"(?:\\[^\n]|[^"\\\n])*"|' + r"'(?:\\[^\n]|[^'\\\n])*'"
#: What begins a comment to the line's end, by format.
LINE_COMMENT = {"c": "//", "cpp": "//", "cpp_header": "//", "fortran": "!", "python": "#"}
C_FAMILY = ("c", "cpp", "cpp_header")


def masked_code(text: Column, format: Column) -> Column:
    """A whole file's code without block comments (their line ends stay), then literals, then line comments, as its format has them."""
    gaps = F.regexp_extract_all(text, F.lit(BLOCK_COMMENT), F.lit(0))
    kept = F.transform(F.split(text, BLOCK_COMMENT, -1), lambda part, k: F.concat(part, F.regexp_replace(F.coalesce(F.get(gaps, k), F.lit("")), "[^\n]", "")))
    out = F.regexp_replace(F.when(format.isin(*C_FAMILY), F.array_join(kept, "")).otherwise(text), LITERAL, "")
    return F.coalesce(*[F.when(format == f, F.regexp_replace(out, mark + "[^\n]*", "")) for f, mark in LINE_COMMENT.items()], out)


def citation_ids(text: Column) -> Column:
    """The ids of strict citation groups such as [S1, S2; S3], in the order of the text."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(S[0-9]+(?:[ ]*[,;][ ]*S[0-9]+)*)\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit("S[0-9]+"), F.lit(0))))


def bounded(text: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """A text of at most `most` characters: three fifths from its head, a mark, the rest from its tail.

    The head ends at its last line end, the tail begins after its first one, unless that costs over half of it. Without room for the mark it is cut.
    """
    room = most - len(marker)
    if room <= 2:
        return F.substring(text, 1, most)
    head_size = max(1, room * 3 // 5)
    tail_size = max(1, room - head_size)
    head, tail = F.substring(text, 1, head_size), text.substr(F.length(text) - tail_size + 1, F.lit(tail_size))
    whole = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1  # characters before the last line end
    begun = F.instr(tail, "\n")
    head = F.when(whole >= head_size // 2, head.substr(F.lit(1), whole)).otherwise(head)
    tail = F.when((begun > 0) & (begun - 1 <= tail_size // 2), tail.substr(begun + 1, F.lit(tail_size))).otherwise(tail)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit(marker), tail))
