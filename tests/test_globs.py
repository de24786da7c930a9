"""glob_policy against its SQL, on ids of any number of digits; extended globs against a regex."""

import random
import re

import duckdb

from lodestone.operators.rollups import glob_regex
from lodestone.plans.registry import QUERIES, SQL


def test_glob_policy_ids_of_any_length(spark, tmp_path):
    ids = [1, 7, 16, 10**5, 123_456, 999_999, 1_234_564, 10**8 + 6, 2 * 10**8 + 2, 10**12, 10**17 + 2, 10**17 + 4]
    rows = [(i, f"text {i}", lang, source, 9) for i in ids for i in (i, i - i % 6 + 4) for lang, source in (("en", "src1"), ("de", "src2"), ("fr", "a/doc_12"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["glob_policy"](spark, str(tmp_path)).select("path", "verdict").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(f"select path, verdict from ({SQL['glob_policy']})").fetchall())
    assert {v for _, v in got} == {"profile_excluded", "outside_profile_scope", "kept"}


def test_extended_globs():
    rnd = random.Random(3)
    for glob, regex in (("*/a*([0-9]).py", r".*/a[0-9]*\.py"), ("a*([!0-9])*([0-9])b", "a[^0-9]*[0-9]*b"), ("*([ab])", "[ab]*"), ("*a*([0-9])b*", ".*a[0-9]*b.*"), ("*.[ch]pp", r".*\.[ch]pp")):
        for text in ["x/a1.py", "x/a.py", "a12b", "", "abab", ".cpp"] + ["".join(rnd.choices("ab12/.py", k=rnd.randint(0, 6))) for _ in range(2000)]:
            assert bool(re.search(glob_regex(glob), text)) == bool(re.fullmatch(regex, text)), (glob, text)
