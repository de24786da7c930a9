"""Prefix trie of conversations, rolled up by pointer jumping.

A prefix is known by a digest of 128 bits: two sums, modulo 2^64, of hashes of its turns (role and text) times powers of an odd base. A
turn's sum with and without itself are its node and its node's parent, so that edges need no join and no text is moved, only
digests. Sums, and places within a conversation, come from sorted ranges of rows: each task numbers and adds up its own range, and the few
ranges that a conversation goes on in get what stands before them, one line for each task. So a conversation of any
length is spread over tasks.

Rollup: a node that one conversation alone runs through has one leaf below it and saves nothing, so only shared nodes need
sums over their subtrees. Each of these starts with its own figures, what its unshared children bring, and its parent as its pointer. A
round adds to each node the figures of those that point to it, and moves each pointer on to its target's pointer, which
doubles its reach: log2 of the shared depth makes the number of rounds. Each round is written to the shared folder.

Lists of the conversations that end in a node are joined in runs of RUN ids, and a task hashes a node's runs in order, so that it
holds one run at a time.

A null role or text is empty. Rows of a null conv_id belong to no conversation and are left out. Turns of one number, null ones
first, are in the order of their digests; repeated rows are turns of their own. Remainders are those of division towards zero. An
empty table gives no rows. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import _BASE, Powers, bounded_batches, mix, narrow, partitions_for, ship, written

#: A conversation's head comes from the first of its family of FAMILY ids, and has fewer than HEADS turns.
FAMILY, HEADS = 5, 9
#: Bits of the ids that make a run of ends.
RUN = 12
FULL = (1 << 64) - 1
SCANNED = "conv_id long, place long, n1 long, n2 long, p1 long, p2 long, digest binary, bytes long, task int"
EMPTY = hashlib.sha256(b"").hexdigest()


class Prefixes:
    """Places within a key and sums over its rows so far, for rows in the order of their keys, batch by batch."""

    def __init__(self):
        self.powers, self.key, self.count, self.sums = Powers(), None, 0, [np.uint64(0)] * 2

    def __call__(self, keys: np.ndarray, terms: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(places, for each of the terms: sums with and without the row)."""
        n = len(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        goes_on = int(keys[0]) == self.key
        place = np.arange(n) - first[own] + np.where(own == 0, self.count if goes_on else 0, 0)
        up, _ = self.powers.to(int(place.max()) + 1)
        out = []
        with np.errstate(over="ignore"):
            for k, t in enumerate(terms):
                term = t * up[place]
                total = np.cumsum(term)
                before = total - term
                start = before[first].copy()
                if goes_on:
                    start[0] -= self.sums[k]
                out.append((total - start[own], before - start[own]))
                self.sums[k] = out[-1][0][-1]
        self.key, self.count = int(keys[-1]), int(place[-1]) + 1
        return place, out


def _open_ends(tasks: list) -> dict[int, tuple[int, int, list[int]]]:
    """{task: (key, rows and sums of that key in the tasks before)} for tasks that go on with the last key of the one before."""
    out, key, count, sums = {}, None, 0, [0, 0]
    for t in sorted(tasks, key=lambda t: t.task):
        if t.first == key:
            out[t.task] = (key, count, sums)
        else:
            count, sums = 0, [0, 0]
        if t.last != t.first:
            count, sums = 0, [0, 0]
        power = pow(_BASE, count, 1 << 64)
        key, count, sums = t.last, count + t.at + 1, [(s + power * own) & FULL for s, own in zip(sums, (t.n1, t.n2))]
    return out


def prefixes(rows: DataFrame, *order: Column) -> DataFrame:
    """(conv_id, place, n1, n2, p1, p2, digest, bytes) of rows (conv_id, digest, bytes, ...) in this order within conv_id."""
    spark = rows.sparkSession

    def local(batches):
        from pyspark import TaskContext

        task, scan = TaskContext.get().partitionId(), Prefixes()
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, 2)
            place, sums = scan(batch.column(0).to_numpy(), [mix(words[:, k] + np.uint64(k + 1)) for k in range(2)])
            (n1, p1), (n2, p2) = sums
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), *[pa.array(x.view(np.int64)) for x in (n1, n2, p1, p2)], batch.column(1), batch.column(2), pa.array(np.full(len(place), task, np.int32))], names=[c.split()[0] for c in SCANNED.split(", ")])

    by = [F.col("conv_id").asc(), *order]
    ranged = rows.repartitionByRange(partitions_for(rows), *by).sortWithinPartitions(*by).select("conv_id", "digest", "bytes")
    scanned = written(ranged.mapInArrow(local, SCANNED))
    last = F.struct("conv_id", "place", "n1", "n2")
    tasks = scanned.groupBy("task").agg(F.min("conv_id").alias("first"), F.max(last).alias("last")).selectExpr("task", "first", "last.conv_id as last", "last.place as at", "last.n1 as n1", "last.n2 as n2")
    before = _open_ends(tasks.collect())  # a line for each task

    def whole(batches):
        for batch in batches:
            keys, tasks = batch.column(0).to_numpy(), batch.column(8).to_numpy()
            place, sums = batch.column(1).to_numpy().copy(), [batch.column(k).to_numpy().view(np.uint64).copy() for k in range(2, 6)]
            for task in np.unique(tasks).tolist():
                if task in before:
                    key, count, offsets = before[task]
                    on = (tasks == task) & (keys == key)
                    place[on] += count
                    with np.errstate(over="ignore"):
                        for k, x in enumerate(sums):
                            x[on] = np.uint64(offsets[k % 2]) + x[on] * np.uint64(pow(_BASE, count, 1 << 64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(place), *[pa.array(x.view(np.int64)) for x in sums], batch.column(6), batch.column(7)], names=[c.split()[0] for c in SCANNED.split(", ")[:-1]])

    return scanned.mapInArrow(whole, SCANNED.rpartition(",")[0])


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_ids, (conv_id, side, place, digest, bytes)): the turns of each conversation, whose first ones come from its family's first."""
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    ids = turns.filter("place = 0").select("conv_id")
    own = turns.filter(F.col("place") >= h).select("conv_id", F.lit(1).alias("side"), "place", "digest", "bytes")
    head = turns.filter((F.col("place") < heads - 1) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("giver"), "place", "digest", "bytes")
    takers = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("giver"), h.alias("h")).filter("h > 0")
    given = takers.join(head, "giver").filter("place < h").select("conv_id", F.lit(0).alias("side"), "place", "digest", "bytes")
    return ids, own.union(given)


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(n1, n2, leaves, saved) summed over subtrees, of nodes (n1, n2, depth, p1, p2, leaves, saved) that hold their parents."""
    now, reach = written(nodes.withColumnsRenamed({"p1": "q1", "p2": "q2"})), 1
    deepest = now.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        pointing = now.filter(F.col("depth") >= reach)
        brought = pointing.groupBy(F.col("q1").alias("n1"), F.col("q2").alias("n2")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("also"))
        jumps = pointing.select(F.col("n1").alias("q1"), F.col("n2").alias("q2"), F.col("q1").alias("r1"), F.col("q2").alias("r2"))
        own = ["n1", "n2", "depth", "leaves", "saved"]
        far = now.filter(F.col("depth") >= 2 * reach).join(jumps, ["q1", "q2"]).select(*own, F.col("r1").alias("q1"), F.col("r2").alias("q2"))
        near = now.filter(F.col("depth") < 2 * reach).select(*own, F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
        summed = [(F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a) for a, b in (("leaves", "more"), ("saved", "also"))]
        now = written(far.union(near).join(brought, ["n1", "n2"], "left").select("n1", "n2", "depth", "q1", "q2", *summed))
        reach *= 2
    return now.select("n1", "n2", "leaves", "saved")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of ends (conv_id, n1, n2): hashes of the ids that end in a node, in their order, comma-joined."""
    run = F.shiftright("conv_id", RUN).alias("run")
    runs = ends.groupBy("n1", "n2", run).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_pydict({"n1": [key[0]], "n2": [key[1]], "ends_sha256": [state.hexdigest()]})

        for batch in batches:
            out = []
            for n1, n2, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (n1, n2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (n1, n2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["n1", "n2", "ends_sha256"])
        if key:
            yield row()

    return runs.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "run").select("n1", "n2", "ids").mapInArrow(hashed, "n1 long, n2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bounded_batches(conversations.sparkSession)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    kept = narrow(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    turns = written(kept.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")))
    ids, rows = rebuilt(prefixes(turns, F.col("turn").asc_nulls_first(), F.col("digest").asc()))
    rows = prefixes(written(rows), F.col("side").asc(), F.col("place").asc())
    none = F.lit(None).cast("long")
    start = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("bytes"))
    members = written(rows.select("conv_id", (F.col("place") + 1).alias("depth"), "n1", "n2", "p1", "p2", "bytes").union(start))
    nodes = members.groupBy("n1", "n2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("depth", "p1", "p2", "bytes")])
    nodes = written(nodes)
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    nodes = written(nodes.join(children, ["n1", "n2"], "left").na.fill(0, ["n_children", "alone"]))
    leaves = F.col("alone") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    shared = nodes.filter("n_convs > 1").select("n1", "n2", "depth", "p1", "p2", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    ends = ends_digests(members.groupBy("conv_id").agg(F.max_by("n1", "depth").alias("n1"), F.max_by("n2", "depth").alias("n2")))
    parents = nodes.filter("n_children > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(rolled_up(shared), ["n1", "n2"], "left").join(ends, ["n1", "n2"], "left").join(parents, ["p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
with t as materialized (
    select conv_id, turn, coalesce(text, '') as text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest
    from conversations where conv_id is not null),
o as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, digest) - 1 as i from t),
c as materialized (
    select conv_id, conv_id - conv_id % {FAMILY} as giver,
           xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
               lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % {HEADS} as h
    from (select distinct conv_id from t)),
r as (
    select c.conv_id, 0 as side, i, text, digest from c join o on o.conv_id = c.giver and i < h
    union all select conv_id, 1, i, text, digest from c join o using (conv_id) where i >= h),
p as materialized (
    select conv_id, strlen(text) as bytes, row_number() over w as depth, string_agg(digest, '') over w as path
    from r window w as (partition by conv_id order by side, i rows unbounded preceding)),
m as materialized (
    select conv_id, depth, bytes, md5(path) as node, md5(substr(path, 1, 32 * (depth - 1))) as parent from p
    union all select conv_id, 0, 0, md5(''), null from c),
n as materialized (
    select node, min(conv_id) as conv_id, any_value(depth) as depth, any_value(parent) as parent, count(*) as n_convs, any_value(bytes) as bytes from m group by node),
k as (select parent as node, count(*) as n_children from n group by parent),
below as (
    select m.node, count(*) filter (k.node is null) as n_leaves, sum((n.n_convs - 1) * n.bytes) as saved
    from n left join k using (node) join m on m.conv_id = n.conv_id and m.depth <= n.depth group by m.node),
e as (
    select node, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends
    from (select conv_id, arg_max(node, depth) as node from m group by conv_id) group by node)
select n.conv_id, n.depth, q.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, n_leaves,
       cast(saved as bigint) as saved_tokens, coalesce(ends, '{EMPTY}') as ends_sha256
from n join below using (node) left join k using (node) left join e using (node) left join n q on q.node = n.parent
"""

ship(__name__)
