"""Code, line by line: what is named, what refers to other files, what is called, and which symbols a call may mean.

Lines are read as words around brackets, after comments and literals have been taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import C_FAMILY, leaf_name, masked_code
from lodestone.sources.store import cut

#: Words before a bracket that are no calls; kinds of named parts whose lines are looked at for calls.
STOP_WORDS = ("alignof", "catch", "decltype", "defined", "do", "else", "for", "if", "return", "sizeof", "switch", "typeid", "while")
CALLING = ("function", "program", "subroutine")
CALL_FORMATS = (*C_FAMILY, "fortran", "python")
#: Words that may stand between a function's brackets and its body.
_TRAILING = ("const", "final", "noexcept", "override")


def code_lines(files: DataFrame) -> DataFrame:
    """doc_id, path, format, line, text and masked (the line without comments and literals) of files (doc_id, path, format, text)."""
    both = F.arrays_zip(F.split("text", "\n").alias("t"), F.split(masked_code(F.col("text"), F.col("format")), "\n").alias("m"))
    return files.select("doc_id", "path", "format", F.posexplode(both).alias("_k", "_x")).select("doc_id", "path", "format", (F.col("_k") + 1).alias("line"), F.col("_x.t").alias("text"), F.col("_x.m").alias("masked"))


def _words(text: Column, more: str = "") -> Column:
    """The runs of letters, digits, underscores and the characters `more` of a text."""
    return F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9_{more}]+"), F.lit(0))


def _named(word: Column) -> Column:
    return F.coalesce(word, F.lit("")).rlike("^~?[A-Za-z_]")


def anchors(lines: DataFrame) -> DataFrame:
    """doc_id, line, title, kind of the lines at which a named part of code begins.

    C and C++: a type after class, struct or enum; a function whose brackets are closed in the line and followed by nothing but
    qualifiers, then a brace or nothing, with a type before its name or a scope in it. Fortran: module, subroutine, function or program
    first. CMake: function or macro. Shell: a name with a brace at the line's end. STOP_WORDS name nothing.
    """
    m = F.trim("masked")
    head = F.substring_index(m, "{", 1)
    before, words = F.substring_index(m, "(", 1), _words(m)
    first, second = F.lower(F.get(words, 0)), F.get(words, 1)
    left = _words(before, ":~")
    name, tail = F.get(left, F.size(left) - 1), F.substring_index(head, ")", -1)
    is_type = first.isin("class", "struct", "enum")
    type_name = F.when((first == "enum") & (F.lower(second) == "class"), F.get(words, 2)).otherwise(second)
    qualified = F.size(F.array_except(_words(tail), F.array(*map(F.lit, _TRAILING)))) == 0
    typed = (F.size(left) > 1) & ~F.lower(F.get(left, 0)).isin(*STOP_WORDS, "new", "delete", "throw") | F.contains(name, F.lit("::"))
    plain = before.rlike("[A-Za-z0-9_]$") & ~before.rlike("[=.,]") & ~F.contains(head, F.lit(";"))
    is_function = F.contains(head, F.lit("(")) & F.contains(head, F.lit(")")) & qualified & typed & plain
    part = lambda title, kind: F.struct(title.alias("title"), kind.alias("kind"))
    c = F.when(is_type & _named(type_name), part(type_name, F.lit("type"))).when(is_function & _named(name), part(name, F.lit("function")))
    fortran = F.when(first.isin("module", *CALLING) & _named(second) & ~((first == "module") & (F.lower(second) == "procedure")), part(second, first))
    inner = F.get(F.filter(F.split(F.substring_index(F.substring_index(m, ")", 1), "(", -1), r"\s+"), lambda x: x != ""), 0)
    cmake = F.when(F.lower(F.trim(before)).isin("function", "macro") & F.contains(m, F.lit("(")), part(inner, F.lower(F.trim(before))))
    shell_name = F.when(first == "function", second).otherwise(F.get(words, 0))
    shell = F.when(m.endswith("{") & (F.size(words) == F.when(first == "function", 2).otherwise(1)) & _named(shell_name), part(shell_name, F.lit("function")))
    found = F.when(F.col("format").isin(*C_FAMILY), c).when(F.col("format") == "fortran", fortran).when(F.col("format") == "cmake", cmake).when(F.col("format") == "shell", shell)
    rows = lines.select("doc_id", "line", found.alias("a")).filter("a.title is not null").select("doc_id", "line", "a.title", "a.kind")
    return rows.filter(~F.lower(leaf_name(F.col("title"))).isin(*STOP_WORDS))


def references(lines: DataFrame) -> DataFrame:
    """doc_id, kind, target, line: references of code lines (doc_id, format, line, text, masked), each target once a document, at its first line.

    C and C++: what is included, in quotes or angles. Fortran: modules used, also after a nature and two colons. Python: modules imported, each
    of several, or imported from. CMake: subdirectories and included files. Shell: sourced files.
    """
    t = F.trim("text")
    hash_line = F.trim(F.expr("substring(trim(text), 2)"))
    rest = F.trim(F.expr("substring(trim(substring(trim(text), 2)), 8)"))
    closing = F.when(F.left(rest, F.lit(1)) == "<", F.lit(">")).when(F.left(rest, F.lit(1)) == '"', F.lit('"'))
    included = F.when(t.startswith("#") & hash_line.startswith("include") & closing.isNotNull() & (F.instr(F.expr("substring(trim(substring(trim(substring(trim(text), 2)), 8)), 2)"), '"') + F.instr(rest, ">") > 0), F.get(F.split(rest, '[<>"]'), 1))
    word = F.split(t, r"[\s(]+")
    head = F.lower(F.get(word, 0))
    module = F.get(_words(F.when(F.contains(t, F.lit("::")), F.substring_index(t, "::", -1)).otherwise(F.expr("substring(trim(text), 4)"))), 0)
    several = F.transform(F.split(F.expr("substring(split(trim(text), '#')[0], 7)"), ","), lambda x: F.get(F.split(F.trim(x), r"\s+"), 0))
    argument = F.get(F.filter(F.split(F.substring_index(F.substring_index(t, ")", 1), "(", -1), r"\s+"), lambda x: x != ""), 0)
    called = F.lower(F.trim(F.substring_index(t, "(", 1)))
    item = lambda kind, targets: F.struct(F.lit(kind).alias("kind"), targets.alias("targets"))
    fmt = F.col("format")
    found = (
        F.when(fmt.isin(*C_FAMILY), F.when(included.isNotNull(), item("includes", F.array(included))))
        .when(fmt == "fortran", F.when((head == "use") | head.startswith("use,"), item("uses_module", F.array(module))))
        .when(fmt == "python", F.when(head == "import", item("imports", several)).when((head == "from") & (F.get(word, 2) == "import"), item("imports", F.array(F.get(word, 1)))))
        .when(fmt == "cmake", F.when(F.contains(t, F.lit("(")) & (called == "add_subdirectory"), item("adds_directory", F.array(argument))).when(F.contains(t, F.lit("(")) & (called == "include"), item("includes", F.array(argument))))
        .when(fmt == "shell", F.when(F.get(word, 0).isin("source", "."), item("sources", F.array(F.substring_index(F.get(word, 1), ";", 1)))))
    )
    rows = lines.select("doc_id", "line", found.alias("f")).filter("f is not null").select("doc_id", "line", "f.kind", F.explode("f.targets").alias("target"))
    return rows.filter(F.coalesce("target", F.lit("")) != "").groupBy("doc_id", "kind", "target").agg(F.min("line").alias("line"))


def leaf_of(target: Column) -> Column:
    """What a call's target ends in, in small letters."""
    return F.lower(F.get(F.reverse(_words(target)), 0))


def call_targets(masked: Column, format: Column) -> Column:
    """Names with their receivers before each bracket of a line; in Fortran also those after the word call."""
    pieces = F.split(F.replace(masked, F.lit("->"), F.lit("→")), r"\(")
    ends = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.replace(F.regexp_extract(F.rtrim(p), "([A-Za-z0-9_:.→]*)$", 1), F.lit("→"), F.lit("->")))
    names = F.transform(ends, lambda p: F.ltrim(p, F.lit("0123456789:.->")))
    words = _words(masked)
    after = F.filter(words, lambda w, k: (k > 0) & (F.lower(F.get(words, k - 1)) == "call"))
    names = F.when(format == "fortran", F.concat(after, names)).otherwise(names)
    return F.array_distinct(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != ""))


def call_tokens(lines: DataFrame) -> DataFrame:
    """doc_id, line, target, leaf: called names in the functions, programs and subroutines of code_lines, each once a line.

    A part's own name is no call in the line that begins it, nor, in C and C++, before its body's first brace.
    """
    so_far = Window.partitionBy("doc_id").orderBy("line")
    rows = lines.join(anchors(lines).select("doc_id", "line", "title", "kind"), ["doc_id", "line"], "left")
    rows = rows.withColumns({"_part": F.count("title").over(so_far), "_own": F.lower(leaf_name(F.last("title", True).over(so_far))), "_kind": F.last("kind", True).over(so_far)})
    within = Window.partitionBy("doc_id", "_part").orderBy("line")
    braces = F.sum(F.contains("masked", F.lit("{")).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_body", ~F.col("format").isin(*C_FAMILY) | (F.coalesce(braces, F.lit(0)) > 0))
    rows = rows.filter(F.col("_kind").isin(*CALLING) & F.col("format").isin(*CALL_FORMATS))
    out = rows.withColumn("target", F.explode(call_targets(F.col("masked"), F.col("format")))).withColumn("leaf", leaf_of(F.col("target")))
    brace, at = F.instr("masked", "{"), F.expr("instr(masked, target)")
    heading = F.col("title").isNotNull() & F.when(F.col("format").isin(*C_FAMILY), (brace == 0) | (at < brace)).otherwise(True)
    own = (F.col("leaf") == F.col("_own")) & (heading | (~F.col("_body") & ((brace == 0) | (at < brace))))
    return out.filter(F.col("leaf").isNotNull() & ~F.col("leaf").isin(*STOP_WORDS) & ~own).select("doc_id", "line", "target", "leaf")


def name_parts(text: Column) -> Column:
    """The distinct parts of names, of two characters or more, apart at signs and where small letters end, without self and this."""
    apart = F.regexp_replace(text, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(apart), "[^a-z0-9]+"), lambda x: (F.length(x) > 1) & ~x.isin("self", "this")))


#: Calls, and symbols, of one target that a task pairs at a time.
CELL = 1024


def call_candidates(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (doc_id, line, target, leaf) with target_doc, qualified_name and resolution of each symbol (doc_id, qualified_name) that may be meant.

    The ladder: symbols whose qualified name ends in the target, if it is qualified (exact_qualified); the only one of its name
    (unique_name); those whose owner shares the largest part of its words with the receiver (receiver_hint); all (branch_unique).

    The ladder is climbed once for each target and qualified name. The result has a row for each call and symbol of a target, so it grows
    with the product of the two; a target's calls and symbols are dealt out in cells of CELL by CELL, and nothing is shuffled after that.
    """
    calls = cut(calls)
    s = cut(symbols.select(F.col("doc_id").alias("target_doc"), "qualified_name", F.lower(leaf_name(F.col("qualified_name"))).alias("leaf")))
    up_to = lambda text, size: F.expr(f"left({text}, greatest(0, length({text}) - {size}))")
    owner = name_parts(up_to("qualified_name", "length(leaf)"))
    receiver = name_parts(up_to("target", "length(leaf)"))
    names = s.groupBy("leaf", "qualified_name").agg(F.count("*").alias("_count")).withColumn("_owner", owner)
    of = Window.partitionBy("target")
    rows = calls.groupBy("target", "leaf").agg(F.count("*").alias("_calls")).withColumn("_receiver", receiver).join(names, "leaf")
    rows = rows.withColumns({"_exact": F.contains("target", F.lit("::")) & F.lower("qualified_name").endswith(F.lower("target")), "_part": F.coalesce(F.try_divide(F.size(F.array_intersect("_receiver", "_owner")), F.size("_owner")), F.lit(0.0))})
    rows = rows.withColumns({"_any": F.max("_exact").over(of), "_n": F.sum("_count").over(of), "_most": F.max("_part").over(of)})
    how = F.when(F.col("_any"), "exact_qualified").when(F.col("_n") == 1, "unique_name").when(F.col("_most") > 0, "receiver_hint").otherwise("branch_unique")
    kept = F.when(how == "exact_qualified", F.col("_exact")).when(how == "receiver_hint", F.col("_part") == F.col("_most")).otherwise(F.lit(True))
    blocks = lambda n: F.ceil(n / CELL).cast("int")
    meant = rows.withColumn("resolution", how).filter(kept).withColumns({"_across": blocks(F.col("_calls")), "_down": blocks(F.sum("_count").over(of))}).select("target", "qualified_name", "resolution", "_across", "_down")
    block = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda side: side.repartition(4 * int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target", "_x", "_y")
    left = calls.join(meant.select("target", "_across", "_down").distinct(), "target").withColumns({"_x": block("_across", "doc_id", "line"), "_y": each("_down")})
    right = meant.join(s.drop("leaf"), "qualified_name").withColumns({"_y": block("_down", "target_doc", "qualified_name"), "_x": each("_across")})
    out = deal(left.drop("_across", "_down")).join(deal(right.drop("_across", "_down")), ["target", "_x", "_y"])
    return out.select("doc_id", "line", "target", "leaf", "target_doc", "qualified_name", "resolution")
