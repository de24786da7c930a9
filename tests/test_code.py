"""Code read line by line: names, references, calls and the symbols that calls may mean."""

from lodestone.operators import code

FILES = [
    (1, "app/main.cpp", "cpp", '#include "engine/core.hpp"\n/* old( );\n * x * f(1)\n */\nint run()\n{ core->start(); Clock::tick(); helper(1);\n  // fake() and "fake("\n  if (x) done("call(2)", \'q(1)\', "a\\"b(3)"); run(); new_one(4);\n}\n# include <vector>'),
    (2, "app/engine/core.cpp", "cpp", 'void Core::start(){ thing.go(); alphaGo.go(); }\nvoid Core::step() const noexcept { Clock::tick(); sizeof(int); }\nvoid tools::Clock::tick() {}\nint x = f(1);\nvoid later();\nreturn g(2)'),
    (3, "app/engine/core.hpp", "cpp_header", "class Core { void start(); };\nenum class Mode { a };\nstruct Clock;\nclass ~odd"),
    (4, "num/step.f90", "fortran", "module steps\nuse iso_c_binding\nuse, intrinsic :: iso_fortran_env, only: int32\nsubroutine advance(x)\n  call helper(x) ! call never(1)\n  CALL bare\n  y = f('call no(1)')\nend subroutine\nmodule procedure p"),
    (5, "CMakeLists.txt", "cmake", "add_subdirectory(app)\nfunction(helper a)\nendfunction()\nMACRO( tool )\ninclude( cmake/x.cmake )"),
    (6, "tools/env.sh", "shell", "source ${HOME}/lib.sh\nsetup() {\n  run\n}\nfunction stop {\n. ./other.sh; go"),
    (7, "tools/r.py", "python", "import os, sys as s\nfrom engine.core import x\nimportant = 1\nfrom x"),
    (8, "lib/alpha.cpp", "cpp", '#include "${DIR}/core.hpp"\nint AlphaGo::go() { return 1; }\nvoid Beta::go()\n{ go(); done(); }\nvoid done(int a) { }'),
    (9, "none.cpp", "cpp", None),
]


def lines(spark):
    return code.code_lines(spark.createDataFrame(FILES, "doc_id long, path string, format string, text string"))


def test_anchors(spark):
    got = sorted((r.doc_id, r.line, r.title, r.kind) for r in code.anchors(lines(spark)).collect())
    assert got == [
        (1, 5, "run", "function"), (2, 1, "Core::start", "function"), (2, 2, "Core::step", "function"), (2, 3, "tools::Clock::tick", "function"), (3, 1, "Core", "type"), (3, 2, "Mode", "type"), (3, 3, "Clock", "type"), (3, 4, "odd", "type"),
        (4, 1, "steps", "module"), (4, 4, "advance", "subroutine"), (5, 2, "helper", "function"), (5, 4, "tool", "macro"), (6, 2, "setup", "function"), (6, 5, "stop", "function"), (8, 2, "AlphaGo::go", "function"), (8, 3, "Beta::go", "function"), (8, 5, "done", "function"),
    ]


def test_references(spark):
    got = sorted((r.doc_id, r.line, r.kind, r.target) for r in code.references(lines(spark)).collect())
    assert got == [
        (1, 1, "includes", "engine/core.hpp"), (1, 10, "includes", "vector"), (4, 2, "uses_module", "iso_c_binding"), (4, 3, "uses_module", "iso_fortran_env"), (5, 1, "adds_directory", "app"), (5, 5, "includes", "cmake/x.cmake"),
        (6, 1, "sources", "${HOME}/lib.sh"), (6, 6, "sources", "./other.sh"), (7, 1, "imports", "os"), (7, 1, "imports", "sys"), (7, 2, "imports", "engine.core"), (8, 1, "includes", "${DIR}/core.hpp"),
    ]


def test_calls(spark):
    got = sorted((r.doc_id, r.line, r.target) for r in code.call_tokens(lines(spark)).collect())
    assert got == [(1, 6, "Clock::tick"), (1, 6, "core->start"), (1, 6, "helper"), (1, 8, "done"), (1, 8, "new_one"), (1, 8, "run"), (2, 1, "alphaGo.go"), (2, 1, "thing.go"), (2, 2, "Clock::tick"), (2, 4, "f"), (2, 5, "later"), (2, 6, "g"), (4, 5, "helper"), (4, 6, "bare"), (4, 7, "f"), (8, 4, "done"), (8, 4, "go")]


def test_candidates(spark):
    own = lines(spark)
    symbols = code.anchors(own).filter("kind in ('function', 'subroutine')").withColumnRenamed("title", "qualified_name")
    got = {(r.doc_id, r.target, r.qualified_name): r.resolution for r in code.call_candidates(code.call_tokens(own), symbols).collect()}
    assert got[1, "Clock::tick", "tools::Clock::tick"] == "exact_qualified" and got[1, "core->start", "Core::start"] == "unique_name"
    assert got[2, "alphaGo.go", "AlphaGo::go"] == "receiver_hint" and (2, "alphaGo.go", "Beta::go") not in got
    assert got[2, "thing.go", "AlphaGo::go"] == got[2, "thing.go", "Beta::go"] == "branch_unique"
