"""Code operators as queries. The files come from `documents`: each line of a C++, Fortran or Python document is made code of its first words.

By turns of six lines: a definition, calls, a reference, a comment with what is no call, a type or module, an end. The SQL says what is to
be found from this alone, it reads no code.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import code, graph
from lodestone.plans.base import query

#: Lines by format and turn; {a} and {b} are the line's words, {n} the document's number.
LINES = {
    "cpp": ("}", "int {a}::{b}(int v) const {", '  {a}_f(1); obj->{b}("no(1)"); // never(2)', '#include "{a}/doc_{n}.hpp"', "/* {a}(3) */ int v = 0;", "class {a}"),
    "fortran": ("end", "subroutine {a}(v)", "  call {b}_f(v) ! call never(v)", "use {a}, only: {b}", "! {a}(3)", "module {a}"),
    "python": ("", "def {a}(v):", "  {a}_f(v)  # never(v)", "from {a}.{b} import v", "# {a}(3)", "import {a}, {b}"),
}
_FORMATS = {"cpp": "cpp", "hpp": "cpp_header", "f90": "fortran", "py": "python"}


def _case(values: dict[str, str], by: str) -> str:
    return f"case {by} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


def _files(c, d):
    """doc_id, path, format, text of the derived files; blank lines of the documents are none of theirs."""
    first = lambda k: F.coalesce(F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), k), F.lit("w"))
    fmt = F.expr(_case({k: f"'{v}'" for k, v in _FORMATS.items()}, "format"))
    rows = c.filter(F.col("format").isin(*_FORMATS)).withColumns({"_fmt": fmt, "_a": first(0), "_b": first(1), "_k": F.col("line") % 6})
    line = F.lit(None).cast("string")
    for name, turns in LINES.items():
        own = F.col("_fmt").startswith(name) if name == "cpp" else F.col("_fmt") == name
        for k, form in enumerate(turns):
            filled = F.replace(F.replace(F.replace(F.lit(form), F.lit("{a}"), F.col("_a")), F.lit("{b}"), F.col("_b")), F.lit("{n}"), (F.col("doc_id") + 1).cast("string"))
            line = F.when(own & (F.col("_k") == k), filled).otherwise(line)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", line.alias("made")))), lambda x: x["made"]), "\n")
    return rows.groupBy("doc_id", "path", "_fmt").agg(text.alias("text")).withColumnRenamed("_fmt", "format")


_SRC = f"""
, src as materialized (
    select doc_id, path, {_case({k: f"'{v}'" for k, v in _FORMATS.items()}, 'format')} as format, line % 6 as k, cast(row_number() over (partition by doc_id order by line) as int) as line,
           coalesce(w[1], 'w') as a, coalesce(w[2], 'w') as b, doc_id + 1 as n
    from (select *, regexp_extract_all(lower(text), '[a-z]+') as w from chunks where format in {tuple(_FORMATS)}))
, part as materialized (
    select doc_id, line, case when format like 'cpp%' and k = 1 then a || '::' || b else a end as title,
           case when k = 1 then (case when format = 'fortran' then 'subroutine' else 'function' end) when format = 'fortran' then 'module' else 'type' end as kind
    from src where k in (1, 5) and format <> 'python' and not (case when format like 'cpp%' and k = 1 then b else a end) in {code.STOP_WORDS})
, ref as materialized (
    select doc_id, kind, target, min(line) as line from (
        select doc_id, line, 'includes' as kind, a || '/doc_' || n || '.hpp' as target from src where k = 3 and format like 'cpp%'
        union all select doc_id, line, 'uses_module', a from src where k = 3 and format = 'fortran'
        union all select doc_id, line, 'imports', a || '.' || b from src where k = 3 and format = 'python'
        union all select doc_id, line, 'imports', unnest([a, b]) from src where k = 5 and format = 'python') group by all)
, call as materialized (
    select distinct s.doc_id, s.line, unnest(case when format like 'cpp%' then [a || '_f', 'obj->' || b] else [b || '_f'] end) as target
    from src s asof join part p on s.doc_id = p.doc_id and s.line >= p.line where k = 2 and format <> 'python' and kind in ('function', 'subroutine'))
, calls as materialized (select *, lower(regexp_replace(target, '^obj->', '')) as leaf from call where regexp_replace(target, '^obj->', '') not in {code.STOP_WORDS})
"""


@query(_SRC + """
select doc_id, line, case when format like 'cpp%' then ['}', 'int ' || a || '::' || b || '(int v) const {', '  ' || a || '_f(1); obj->' || b || '(); ', '#include ', ' int v = 0;', 'class ' || a][k + 1]
    when format = 'fortran' then ['end', 'subroutine ' || a || '(v)', '  call ' || b || '_f(v) ', 'use ' || a || ', only: ' || b, '', 'module ' || a][k + 1]
    else ['', 'def ' || a || '(v):', '  ' || a || '_f(v)  ', 'from ' || a || '.' || b || ' import v', '', 'import ' || a || ', ' || b][k + 1] end as masked from src
""")
def masked_lines(d, o, c, spark, sf_dir):
    return code.code_lines(_files(c, d)).select("doc_id", "line", "masked")


@query(_SRC + "select * from part")
def code_anchors(d, o, c, spark, sf_dir):
    return code.anchors(code.code_lines(_files(c, d)))


@query(_SRC + "select * from ref")
def references_extract(d, o, c, spark, sf_dir):
    return code.references(code.code_lines(_files(c, d)))


@query(_SRC + """
, pp as (select distinct doc_id, path from src), sf as (select distinct doc_id, array_to_string((string_split(path, '/'))[k:], '/') as s from (select *, unnest(range(1, len(string_split(path, '/')) + 1)) as k from pp))
, u as (select s, min(doc_id) as target_doc from sf group by s having count(distinct doc_id) = 1)
select r.doc_id, kind, target, line, coalesce(target_doc, -1) as target_doc from (select * replace (regexp_replace(target, '^[^/]*/', '') as target) from ref) r left join u on u.s = target
""")
def reference_resolution(d, o, c, spark, sf_dir):
    """Targets without their first directory, as documents' directories are others."""
    files = _files(c, d)
    refs = code.references(code.code_lines(files)).withColumn("target", F.regexp_replace("target", "^[^/]*/", ""))
    return graph.resolve_paths(refs, files.select("doc_id", "path")).na.fill(-1, ["target_doc"])


@query(_SRC + "select * from calls")
def call_tokens(d, o, c, spark, sf_dir):
    return code.call_tokens(code.code_lines(_files(c, d)))


@query(_SRC + """
, sym as (select doc_id as target_doc, title as qualified_name, lower(regexp_replace(title, '^.*::', '')) as leaf from part where kind in ('function', 'subroutine') and line <= 13)
, x as (select k.*, target_doc, qualified_name, case when qualified_name like 'obj::%' and target like 'obj->%' then 1 else 0 end as part from calls k join sym using (leaf))
, y as (select *, count(*) over w as n, max(part) over w as most from x window w as (partition by doc_id, line, target))
select doc_id, line, target, leaf, target_doc, qualified_name, case when n = 1 then 'unique_name' when most > 0 then 'receiver_hint' else 'branch_unique' end as resolution from y where n = 1 or part = most
""")
def call_candidates(d, o, c, spark, sf_dir):
    """Symbols are the functions and subroutines that documents begin with."""
    lines = code.code_lines(_files(c, d))
    symbols = code.anchors(lines).filter("kind in ('function', 'subroutine') and line <= 13").withColumnRenamed("title", "qualified_name")
    return code.call_candidates(code.call_tokens(lines), symbols)
