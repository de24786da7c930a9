"""Excerpts, supported subsets and expectations against plain loops."""

import random
import textwrap

import pytest

from lodestone.operators import evidence

SOURCE = ["def f(x):\n    if x:\n        return 1\n\n    return 2\n", "  def f(x):\n      if x:  \n          return 1\n\n      return 2", "}\n}\n}\na\n}\n}", "\tx\n\t\ty\n\tz", "", None, "a\r\nb\r\n", "same\nsame\nsame\nsame"]
BLOCKS = ["def f(x):\n    if x:\n        return 1", "\n        if x:\n            return 1\n\n        return 2\n\n", "    return 1\n\nreturn 2", "return 1\nreturn 2", "}", "}\n}", "x\n\ty", "x\n y", "a\nb", "same\nsame\n", "if x:\nreturn 1", "", " \n\n", "retur", "    a\n    }\n"]


def stands(code, text):
    """(first, last) of the windows of whole lines that are the code, with one indent of each taken off."""
    want = [line.rstrip() for line in textwrap.dedent(code.replace("\r\n", "\n")).strip("\n").split("\n")]
    lines = (text or "").replace("\r\n", "\n").split("\n")
    out = []
    for k in range(len(lines) - len(want) + 1) if any(want) else []:
        have = [line.rstrip() for line in textwrap.dedent("\n".join(lines[k : k + len(want)])).split("\n")]
        if have == want:
            out.append((k + 1, k + len(want)))
    return out


def test_excerpts(spark):
    rnd = random.Random(2)
    blocks, sources = list(BLOCKS), list(SOURCE)
    for _ in range(40):
        sources.append("\n".join(" " * rnd.randint(0, 3) + rnd.choice(["a", "b", "", "end"]) for _ in range(rnd.randint(1, 12))))
    for _ in range(60):
        own = rnd.choice(sources[len(SOURCE) :]).split("\n")
        k = rnd.randrange(len(own))
        blocks.append(textwrap.indent("\n".join(own[k : k + rnd.randint(1, 4)]), "  "))
    b = spark.createDataFrame(list(enumerate(blocks)), "block_id long, code string")
    s = spark.createDataFrame(list(enumerate(sources)), "source_id long, text string")
    want = {(i, j, *at) for i, code in enumerate(blocks) for j, text in enumerate(sources) for at in stands(code, text)}
    assert set(map(tuple, evidence.excerpts(b, s).select("block_id", "source_id", "first_line", "last_line").collect())) == want
    some = {(i, j) for i, j, _, _ in want if (i + j) % 2}
    allowed = spark.createDataFrame(sorted(some), "block_id long, source_id long")
    assert set(map(tuple, evidence.excerpts(b, s, allowed).select("block_id", "source_id", "first_line", "last_line").collect())) == {w for w in want if w[:2] in some}


def test_code_blocks_and_what_is_kept(spark):
    text = "see\n```c++ x\nint a;\n```\n[S1]\n```\n\n```\n```py\n" + "y" * 9000 + "\n```\n```\r\nlast\r\n```"
    rows = evidence.code_blocks(spark.createDataFrame([(1, text), (2, None), (3, "no code")], "answer_id long, text string")).collect()
    assert [(r.answer_id, r.nth, r.language, r.code) for r in rows] == [(1, 1, "c++x", "int a;\n"), (1, 4, "", "last\n")]
    blocks = spark.createDataFrame([(1,), (2,), (3,), (4,)], "block_id long")
    found = spark.createDataFrame([(1, "S2"), (1, "S1"), (2, "S3"), (2, "S3"), (3, "S1"), (3, "S2")], "block_id long, source_id string")
    cited = spark.createDataFrame([(1, "S2"), (2, "S9"), (4, "S1")], "block_id long, source_id string")
    assert sorted(map(tuple, evidence.kept_blocks(found, cited, blocks).collect())) == [(1, "cited", "S2"), (2, "attached", "S3"), (3, "removed", None), (4, "removed", None)]


ANSWER = [(1, "intro", 0), (2, "# A", 1), (3, "## B", 2), (4, "one", 0), (5, "one", 0), (6, "### C", 3), (7, "bad", 0), (8, "## D", 2), (9, "# E", 1), (10, "## F", 2), (11, "### G", 3), (12, "two", 0), (13, "one", 0), (14, "# H", 1)]


@pytest.mark.parametrize("nested,text", [(False, ["intro", "## B", "one", "### G", "two", "one", "loose"]), (True, ["intro", "# A", "## B", "one", "# E", "## F", "### G", "two", "one", "loose"])])
def test_supported_subset(spark, nested, text):
    lines = spark.createDataFrame([(1, *x) for x in ANSWER] + [(2, 1, "# only", 1), (2, 2, "bad", 0)], "answer_id long, line int, text string, level int")
    claims = [(1, n, 1, x, "uncertain" if x == "bad" else "supported", 1) for n, x, level in ANSWER if not level] + [(2, 2, 1, "bad", "supported", 0), (1, None, 1, "loose", "supported", 2), (1, None, 2, "two", "supported", 2), (1, 4, 2, " ", "supported", 1), (3, None, 1, None, None, None)]
    got = evidence.supported_subset(lines, spark.createDataFrame(claims, "answer_id long, line int, nth int, claim string, verdict string, n_sources int"), nested).collect()
    assert [(r.answer_id, r.text) for r in got] == [(1, "\n\n".join(text))]


RESPONSE = "case_id long, abstained boolean, grounding_status string, answer_completeness string, citations array<string>, invalid_citations array<string>, sources array<struct<project:string,path:string>>, coverage double, scope_coverage double, finish_reason string, client_seconds double, seconds double, scope_warning boolean, intent string, answer string"


def test_expectations(spark):
    full = (1, False, "cited", "complete", ["S1", "S2"], ["S9"], [("p", "a/b"), ("q", "c")], 0.75, 0.5, "stop", 3.0, 2.0, True, "direct", "An Answer")
    responses = spark.createDataFrame([full, (2, *[None] * 14)], RESPONSE)
    rules = [
        ("abstained", "false", None, True, False), ("grounding_status", "cited", None, True, False), ("answer_completeness", "complete", None, True, False), ("min_valid_citations", "2", None, True, False), ("min_valid_citations", "0", None, True, True),
        ("max_invalid_citations", "0", None, False, True), ("min_sources", "3", None, False, False), ("min_citation_coverage", "0.75", None, True, False), ("min_scope_citation_coverage", "0.6", None, False, False), ("allowed_finish_reasons", None, ["length", "stop"], True, False),
        ("max_client_duration_seconds", "3", None, True, False), ("max_generation_duration_seconds", "1.9", None, False, True), ("scope_warning", "true", None, True, False), ("exploration_intent", "location", None, False, False), ("required_source_projects", None, ["p", "q"], True, False),
        ("required_source_paths", None, ["c", "d"], False, False), ("required_source_paths", None, [], True, True), ("forbidden_answer_phrases", None, ["ANSWER"], False, True), ("forbidden_answer_phrases", None, ["bad"], True, True),
    ]
    frame = spark.createDataFrame([(case, n, w, ws) for case in (1, 2, 3) for n, w, ws, _, _ in rules], "case_id long, check string, want string, wants array<string>")
    got = sorted(map(tuple, evidence.expectation_checks(responses, frame).collect()), key=repr)
    assert {n for n, *_ in rules} | {"allowed_grounding_statuses"} == set(evidence.CHECKS)
    assert got == sorted([(case, n, (a, b, False)[case - 1], None) for case in (1, 2, 3) for n, _, _, a, b in rules], key=repr)


@pytest.mark.parametrize("check,want,wants,problem", [("nothing", "x", None, "unknown"), (None, "x", None, "unknown"), ("min_sources", "many", None, "no number"), ("abstained", "perhaps", None, "no boolean"), ("answer_completeness", "half", None, "unknown value"), ("required_source_paths", "x", None, "no list of texts"), ("forbidden_answer_phrases", None, [""], "no list of texts"), ("exploration_intent", None, None, "no text")])
def test_bad_expectations(spark, check, want, wants, problem):
    rules = spark.createDataFrame([(1, check, want, wants)], "case_id long, check string, want string, wants array<string>")
    assert tuple(evidence.expectation_checks(spark.createDataFrame([], RESPONSE), rules).first()) == (1, check, None, problem)


def test_grounding_twice(spark):
    rules = spark.createDataFrame([(1, "grounding_status", "cited", None), (1, "allowed_grounding_statuses", None, ["cited"])], "case_id long, check string, want string, wants array<string>")
    got = {r.check: r.problem for r in evidence.expectation_checks(spark.createDataFrame([], RESPONSE), rules).collect()}
    assert got == {"grounding_status": None, "allowed_grounding_statuses": "given twice"}
