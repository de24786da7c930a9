"""Branch comparison as a query. History comes from `events`: each user's events are a branch, one commit after the other.

User u's first event is made on the last one so far of user (u - 1) / 2, unless u is divisible by 7; purchases merge the last event
so far of user 2u + 1 or 2u + 2, by turns of event_id. The canonical branch is the first user's.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import commits
from lodestone.plans.base import query
from lodestone.sources import corpus


def _history(spark, sf_dir):
    """(commits: commit, time; parents: commit, nth, parent; heads: branch, commit) of the events."""
    e = corpus.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("time"))
    own = Window.partitionBy("user_id").orderBy("time")
    e = e.withColumns({"before": F.lag("event_id").over(own), "after": F.lead("event_id").over(own)})

    def latest(asks, gives, *keys):
        """For rows of `asks` the latest event of `gives` before them, by the same keys."""
        rows = asks.select(*keys, "time", F.col("event_id").alias("asking"), F.lit(None).cast("long").alias("giving")).union(gives.select(*keys, "time", F.lit(None).cast("long"), F.col("event_id")))
        last = F.last("giving", True).over(Window.partitionBy(*keys).orderBy("time"))
        return rows.withColumn("parent", last).filter("asking is not null and parent is not null").select(F.col("asking").alias("commit"), "parent")

    first = e.filter("before is null and user_id > 0 and user_id % 7 <> 0").withColumn("key", F.floor((F.col("user_id") - 1) / 2))
    forks = latest(first, e.withColumn("key", F.col("user_id")), "key")
    merging = e.filter("event_type = 'purchase'").withColumns({"key": F.col("user_id"), "side": F.col("event_id") % 2})
    merged = e.filter("user_id > 0").withColumns({"key": F.floor((F.col("user_id") - 1) / 2), "side": (F.col("user_id") - 1) % 2})
    merges = latest(merging, merged, "key", "side")
    line = e.filter("before is not null").select(F.col("event_id").alias("commit"), F.col("before").alias("parent"))
    parents = line.union(forks).withColumn("nth", F.lit(0)).union(merges.withColumn("nth", F.lit(1))).select("commit", "nth", "parent")
    return e.select(F.col("event_id").alias("commit"), "time"), parents, e.filter("after is null").select(F.col("user_id").alias("branch"), F.col("event_id").alias("commit"))


_HISTORY = """
with recursive e as (select event_id, user_id, event_type, row_number() over (order by ts, event_id) as t from events),
p as materialized (
    select commit, parent from (select event_id as commit, lag(event_id) over (partition by user_id order by t) as parent from e) where parent is not null
    union all select a.event_id, arg_max(g.event_id, g.t) from (select * from (select *, row_number() over (partition by user_id order by t) as r from e) where r = 1 and user_id > 0 and user_id % 7 <> 0) a join e g on g.user_id = (a.user_id - 1) // 2 and g.t < a.t group by 1
    union all select a.event_id, arg_max(g.event_id, g.t) from e a join e g on g.user_id = 2 * a.user_id + 1 + a.event_id % 2 and g.t < a.t where a.event_type = 'purchase' group by 1),
h as materialized (select user_id as branch, arg_max(event_id, t) as head from e group by 1),
"""


@query(_HISTORY + """
reach as (select head, head as commit from h union select head, parent from reach join p using (commit)),
c as materialized (select commit from reach where head = (select head from h where branch = (select min(user_id) from e))),
s as (select head, count(*) filter (c.commit is null) as ahead, count(c.commit) as shared, arg_max(c.commit, t) as merge_base from reach left join c using (commit) join e on event_id = commit group by head)
select branch, head as commit, case when head = (select head from h where branch = (select min(user_id) from e)) then 'same_commit' when shared = 0 then 'unrelated' when ahead = 0 then 'merged' when shared = (select count(*) from c) then 'ahead' else 'diverged' end as relation,
       ahead, (select count(*) from c) - shared as behind, coalesce(merge_base, -1) as merge_base, ahead = 0 as merged_into_canonical
from h join s using (head)
""", pre=False)
def commit_comparison(d, o, c, spark, sf_dir):
    known, parents, heads = _history(spark, sf_dir)
    first = heads.orderBy("branch").limit(1).collect()
    return commits.compare(heads, first[0].commit if first else None, known, parents).na.fill(-1, ["merge_base"])


@query(_HISTORY + """
reach as (select head, head as commit from h union select head, parent from reach join p using (commit))
select branch, count(*) as commits from h join reach using (head) group by branch
""", pre=False)
def branch_history_sizes(d, o, c, spark, sf_dir):
    known, parents, heads = _history(spark, sf_dir)
    laid = commits.chains(known, parents)
    state = commits.reached(heads.select(F.col("commit").alias("head")), parents, laid)
    return heads.withColumnRenamed("commit", "head").join(state, "head").groupBy("branch").agg(F.sum(F.col("at") + 1).alias("commits"))
