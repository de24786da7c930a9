"""Lines are numbered without their texts: only their first words are shuffled."""

from lodestone.plans import registry
from lodestone.sources import corpus


def test_relations_shuffle_no_texts(spark):
    d = corpus.documents(spark, "/root/testdata/sf0.001")
    plan = registry._relations(corpus.occurrences(d), corpus.chunks(d))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[k + 1] for k, line in enumerate(plan) if "Window [" in line]
    assert below and not any(" AS text#" in line for line in below), below
