"""The coverage ledger as queries: users are cases, their events judgements of what their types name."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.base import query
from lodestone.sources import corpus
from lodestone.sources.store import scratch
from lodestone.streaming import ledger

_SAYS = ("covered", "partial", "gap", "covered", "unknown")


def _judgements(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    aspect = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.concat(F.lit("  "), "event_type"))
    ids = F.when(F.col("event_id") % 4 > 0, F.array(F.concat(F.lit("c"), F.col("event_id") % 7), F.concat(F.lit("c"), F.col("event_id") % 5)))
    return e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), aspect.alias("aspect"), corpus.pick(F.col("event_id"), _SAYS).alias("status"), ids.alias("chunk_ids"))


_FOLD = f"""
with j as (select user_id as case_id, event_id as seq, case when event_id % 3 = 0 then upper(event_type) else event_type end as aspect, lower(event_type) as key, ({list(_SAYS)!r})[event_id % {len(_SAYS)} + 1] as said,
                  case when event_id % 4 > 0 then case when event_id % 7 = event_id % 5 then 'c' || event_id % 7 else 'c' || event_id % 7 || ',c' || event_id % 5 end else '' end as ids from events)
, f as (select case_id, key, arg_min(aspect, seq) as aspect, min(seq) as first_seq, max(seq) as last_seq, arg_max(case when said = 'covered' and ids = '' then 'partial' else said end, seq) as status, arg_max(ids, seq) as chunk_ids from j where said <> 'unknown' group by 1, 2)
"""


@query(_FOLD + "select * from f", pre=False)
def coverage_ledger_stream(d, o, c, spark, sf_dir):
    """The events in six files, by their numbers, one a batch."""
    rows, source = _judgements(spark, sf_dir), scratch(spark)
    rows.repartition(6, F.col("seq") % 6).write.parquet(source)
    return ledger.stream_ledger(spark, source, rows.schema).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(_FOLD + """
, need as (select distinct user_id as case_id, unnest([1, 2, 3]) as nth, unnest(['Purchase', 'docs', 'VIEW']) as label from events)
, b as (select coalesce(f.case_id, need.case_id) as case_id, coalesce(f.key, lower(label)) as key, coalesce(label, aspect) as aspect, coalesce(status, 'gap') as status, coalesce(chunk_ids, '') as chunk_ids, nth, first_seq from f full join need on f.case_id = need.case_id and f.key = lower(label))
select case_id, cast(row_number() over (partition by case_id order by nth is null, coalesce(nth, first_seq)) as int) as place, aspect, status, chunk_ids from b
""", pre=False)
def coverage_ledger(d, o, c, spark, sf_dir):
    rows = _judgements(spark, sf_dir)
    need = F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(a).alias("aspect")) for k, a in enumerate(("Purchase", "docs", "VIEW"), 1)])
    required = rows.select("case_id").distinct().select("case_id", F.explode(need).alias("x")).select("case_id", "x.*")
    return ledger.reconciled(ledger.folded(rows), required).withColumn("chunk_ids", F.array_join("chunk_ids", ","))
