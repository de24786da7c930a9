"""Chat formatting in budgeted windows, of SQL functions alone.

Turns are ordered by (turn, role, text). A window is the conversation's first system turn (unless it is in the span), up to
HISTORY_TURNS turns of history before the span, and the span, and holds at most BUDGET tokens: the system turn is taken off, a
quarter of the rest, HISTORY at most, is left for history, and prefix sums of the turns' tokens choose the span, the turns that
begin in one stretch of half of what remains, so that with the last one's end they fit. A turn longer than a stretch is a span
of its own, never cut, and what it takes too much is taken off the history; only a window of one turn that does not fit beside the
system turn exceeds the budget. A system turn of more than half of the budget is not repeated. Repeated turns are
marked so, and only the span's assistant turns are under the loss mask.

The template writes a turn as <|turn|>role<|text|>text<|end|> (<|again|> for a repeated one) and a line end; in roles and texts
& and < are written &a and &l, so that no text can hold a mark, and reading back is exact.

A null text or role is empty; repeated rows are turns of their own; rows without conv_id are one conversation; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import narrow

BUDGET, HISTORY, HISTORY_TURNS = 1024, 256, 4
TURN, AGAIN, TEXT, END = "<|turn|>", "<|again|>", "<|text|>", "<|end|>\n"
EXTRA = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&a")), F.lit("<"), F.lit("&l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&l"), F.lit("<")), F.lit("&a"), F.lit("&"))


def tokens(text: Column) -> Column:
    """An estimate: words, and single characters that are no part of words, and the turn's three marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + 3


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, win (number of the window), formatted, loss (code points from..to of formatted that are trained on)."""
    c = narrow(conversations, "conv_id", "turn", "role", "text").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumns({"n": tokens(F.concat_ws(" ", escaped(F.col("role")), escaped(F.col("text")))), "at": F.row_number().over(order)})
    c = c.withColumn("sys", F.first(F.when(F.col("role") == "system", F.struct("at", "role", "text", "n")), ignorenulls=True).over(whole))
    c = c.withColumn("sys", F.when(2 * F.col("sys.n") <= budget, F.col("sys")))
    c = c.withColumn("room", F.lit(budget) - F.coalesce(F.col("sys.n"), F.lit(0)))
    c = c.withColumn("old_room", F.least(F.lit(history), F.expr("room div 4").cast("int"))).withColumn("half", F.expr("greatest((room - old_room) div 2, 1)"))
    c = c.withColumns(
        {
            "start": F.coalesce(F.sum("n").over(before), F.lit(0)),
            "longs": F.sum((F.col("n") > F.col("half")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "past": F.array(*[F.lag(F.struct("at", "role", "text", "n"), k).over(order) for k in range(HISTORY_TURNS, 0, -1)]),
        }
    )
    key = F.struct("longs", (F.col("n") > F.col("half")).alias("own"), F.expr("start div half").alias("stretch"))
    w = c.groupBy("conv_id", key.alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"), F.min("at").alias("win"), F.min_by("past", "at").alias("past"), F.first("sys").alias("sys"), F.least(F.first("old_room"), F.first("room") - F.sum("n")).alias("left")
    )
    repeats = F.col("sys.at") < F.col("win")
    recent = F.filter(F.filter("past", lambda x: x.isNotNull()), lambda x: (x["at"] != F.coalesce(F.col("sys.at"), F.lit(0))))
    fits = F.transform(recent, lambda x, k: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.aggregate(F.slice(recent, k + 1, F.lit(HISTORY_TURNS)), F.lit(0), lambda a, y: a + y["n"]).alias("upto")))
    w = w.withColumn("old", F.concat(F.when(repeats, F.array(F.struct("sys.role", "sys.text"))).otherwise(F.expr("cast(array() as array<struct<role:string,text:string>>)")), F.transform(F.filter(fits, lambda x: x["upto"] <= F.col("left")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))))
    shown = lambda mark: lambda x: F.concat(F.lit(mark), escaped(x["role"]), F.lit(TEXT), escaped(x["text"]), F.lit(END))
    w = w.withColumns({"_again": F.array_join(F.transform("old", shown(AGAIN)), ""), "_new": F.transform("turns", shown(TURN))})
    w = w.withColumn("_ends", F.transform("_new", lambda x: F.length(x)))
    step = lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), F.when(x["mask"], F.concat(a["loss"], F.array(F.struct((a["at"] + x["head"]).alias("first"), (a["at"] + x["size"] - len(END)).alias("last"))))).otherwise(a["loss"]).alias("loss"))
    marks = F.zip_with("turns", "_ends", lambda t, n: F.struct(n.alias("size"), (t["role"] == "assistant").alias("mask"), (F.length(escaped(t["role"])) + len(TURN) + len(TEXT)).alias("head")))
    loss = F.aggregate(marks, F.struct(F.length("_again").alias("at"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("loss")), step, lambda a: a["loss"])
    return w.select("conv_id", "win", F.concat("_again", F.array_join("_new", "")).alias("formatted"), loss.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, win, turns (array of role and text that the window adds), loss_text, from the formatted windows alone."""
    parts = F.filter(F.split("formatted", r"(?=<\|(?:turn|again)\|>)"), lambda x: x.startswith(TURN))
    body = lambda x: F.split(x.substr(F.lit(len(TURN) + 1), F.length(x) - len(TURN) - len(END)), r"<\|text\|>", 2)
    turns = F.transform(parts, lambda x: F.struct(unescaped(body(x)[0]).alias("role"), unescaped(body(x)[1]).alias("text")))
    loss = F.array_join(F.transform("loss", lambda x: unescaped(F.col("formatted").substr(x["first"] + 1, x["last"] - x["first"]))), "")
    return windows.select("conv_id", "win", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("n"))


def with_extra(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts look like another template's marks."""
    c = narrow(conversations, "conv_id", "turn", "role", "text")
    kinds = dict(c.dtypes)
    extra = c.sparkSession.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"))
    return c.unionByName(extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = read_back(format_windows(with_extra(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = windows.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("win", said.alias("said"), F.col("loss_text").alias("loss")))).alias("w"), F.sum("n").alias("formatted_chars")
    )
    whole = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return per.select("conv_id", "n_turns", F.sha2(whole("said"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"), "formatted_chars")


_SHOWN = "length(er) + length(et)"
SQL = rf"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, k, case when k = 0 then 'user' else 'assistant' end, '{EXTRA}' from range(2) t(k)),
e as (select *, replace(replace(role, '&', '&a'), '<', '&l') as er, replace(replace(text, '&', '&a'), '<', '&l') as et from r),
n as (select *, len(regexp_extract_all(er || ' ' || et, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]')) + 3 as n, row_number() over (partition by conv_id order by turn, role, text) as pos from e),
s as (select conv_id, arg_min(case when 2 * n <= {BUDGET} then pos end, pos) as sys, arg_min(n, pos) as sys_n, arg_min({_SHOWN}, pos) as sys_len from n where role = 'system' group by conv_id),
t as (select n.*, sys, sys_len, {BUDGET} - case when sys is null then 0 else sys_n end as room from n left join s on n.conv_id is not distinct from s.conv_id),
h as (select *, least({HISTORY}, room // 4) as old_room, greatest((room - least({HISTORY}, room // 4)) // 2, 1) as half from t),
k as (select *, coalesce(sum(n) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) // half as stretch, sum(case when n > half then 1 else 0 end) over (partition by conv_id order by pos) as longs from h),
w as (select conv_id, min(pos) as win, sum({_SHOWN} + {len(TURN + TEXT + END)}) as chars, least(any_value(old_room), any_value(room) - sum(n)) as remains, any_value(sys) as sys, any_value(sys_len) as sys_len from k group by conv_id, longs, n > half, stretch),
p as (select w.conv_id, w.win, {_SHOWN} + {len(AGAIN + TEXT + END)} as chars, remains, sum(n) over (partition by w.conv_id, w.win order by k.pos desc) as upto from w join k on w.conv_id is not distinct from k.conv_id and k.pos between w.win - {HISTORY_TURNS} and w.win - 1 and k.pos <> coalesce(w.sys, 0)),
f as (select conv_id, chars from w union all select conv_id, sys_len + {len(AGAIN + TEXT + END)} from w where sys < win union all select conv_id, chars from p where upto <= remains),
q as (select conv_id, cast(sum(chars) as bigint) as formatted_chars from f group by conv_id),
a as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by pos) as said, coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '') as loss from n group by conv_id)
select a.conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from a join q on a.conv_id is not distinct from q.conv_id
"""
