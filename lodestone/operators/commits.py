"""Branches compared by the ancestry of their commits.

Commits are laid out as chains: a commit goes on with one of those that have it as their first parent, others begin chains of their own.
What a head reaches is then one place for each chain, as a commit reaches all before it on its chain; a round follows the links from
what was reached last to other chains. So rounds are as many as branches are nested, however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.store import cut


def chains(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit, chain, at): each commit's chain, named by its first commit, and its place there, from 0.

    commits are (commit, ...), parents (commit, nth, parent), nth 0 for the first. Places come from pointer doubling; in each round
    no two commits have one target, so that no key is hot.
    """
    goes_on = parents.filter("nth = 0").groupBy("parent").agg(F.min("commit").alias("commit"))
    rows = commits.select("commit").distinct().join(goes_on, "commit", "left")
    now = cut(rows.select("commit", F.coalesce("parent", "commit").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("far"), F.col("parent").isNull().alias("done")))
    while not now.filter("not done").isEmpty():
        target = now.select(F.col("commit").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        moved = now.filter("not done").join(target, "to").select("commit", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_done").alias("done"))
        now = cut(now.filter("done").union(moved))
    return now.select("commit", F.col("to").alias("chain"), F.col("far").alias("at"))


def reached(heads: DataFrame, parents: DataFrame, laid: DataFrame) -> DataFrame:
    """(head, chain, at): for each head (a column of commits) the last place of each chain that it reaches, itself included."""
    end = lambda name: laid.select(F.col("commit").alias(name), F.col("chain").alias(f"{name}_chain"), F.col("at").alias(f"{name}_at"))
    links = parents.select("commit", "parent").join(end("commit"), "commit").join(end("parent"), "parent")
    links = cut(links.filter("commit_chain <> parent_chain").select(F.col("commit_chain").alias("chain"), F.col("commit_at").alias("link_at"), F.col("parent_chain").alias("to"), F.col("parent_at").alias("to_at")).distinct())
    start = heads.select("head").distinct().join(laid.withColumnRenamed("commit", "head"), "head")
    state = cut(start.select("head", "chain", "at", F.lit(-1).cast("long").alias("past"), F.lit(True).alias("new")))
    while not state.filter("new").isEmpty():
        found = state.filter("new").join(links, "chain").filter("link_at <= at and link_at > past").groupBy("head", F.col("to").alias("chain")).agg(F.max("to_at").alias("_at"))
        known = state.select("head", "chain", "at")
        both = known.join(found, ["head", "chain"], "full")
        further = F.col("_at").isNotNull() & (F.col("at").isNull() | (F.col("_at") > F.col("at")))
        state = cut(both.select("head", "chain", F.when(further, F.col("_at")).otherwise(F.col("at")).alias("at"), F.coalesce("at", F.lit(-1).cast("long")).alias("past"), further.alias("new")))
    return state.select("head", "chain", "at")


def compare(branches: DataFrame, canonical, commits: DataFrame, parents: DataFrame) -> DataFrame:
    """(branch, commit, relation, ahead, behind, merge_base, merged_into_canonical) of branches (branch, commit) against a canonical commit.

    commits are (commit, time), times later than those of ancestors; the merge base is the common commit of the latest time, then of
    the greatest id. same_commit, unrelated (nothing in common), merged (all is in the canonical history), ahead, or diverged. A head that is
    no known commit gives no row; nor does anything if the canonical one is not.
    """
    laid = cut(chains(commits, parents))
    root = commits.filter(F.col("commit") == canonical).select(F.col("commit").alias("head")).distinct()
    state = cut(reached(branches.select(F.col("commit").alias("head")).union(root), parents, laid))
    own = state.filter(F.col("head") == canonical).select("chain", F.col("at").alias("canonical_at"))
    total = own.agg(F.coalesce(F.sum(F.col("canonical_at") + 1), F.lit(0)).alias("total"), F.count("*").alias("n")).filter("n > 0")
    met = state.join(own, "chain", "left").withColumn("common", F.least("at", F.coalesce("canonical_at", F.lit(-1))))  # places of both, on each chain
    base = met.filter("common >= 0").select("head", "chain", F.col("common").alias("at")).join(laid, ["chain", "at"]).join(commits.select("commit", "time"), "commit")
    base = base.groupBy("head").agg(F.max_by("commit", F.struct("time", "commit")).alias("merge_base"))
    sums = met.groupBy("head").agg(F.sum(F.col("at") - F.col("common")).alias("ahead"), F.sum(F.col("common") + 1).alias("shared"))
    rows = branches.join(sums.join(base, "head", "left").withColumnRenamed("head", "commit"), "commit").join(F.broadcast(total))  # of one row
    behind = F.col("total") - F.col("shared")
    relation = F.when(F.col("commit") == canonical, "same_commit").when(F.col("shared") == 0, "unrelated").when(F.col("ahead") == 0, "merged").when(behind == 0, "ahead").otherwise("diverged")
    return rows.select("branch", "commit", relation.alias("relation"), "ahead", behind.alias("behind"), "merge_base", (F.col("ahead") == 0).alias("merged_into_canonical"))
