"""Exact top-k search by integer inner products, over a bit-sliced index.

Index: each task packs the vectors that it reads, BLOCK rows at a time in the order of vec_id, into bitmaps: one for each bit of each
attribute (the quantised component, less the block's least). There is no shuffle, and every row is in one block.

Search: a query's weight for an attribute is a sum of signed powers of two. For each, the attribute's slices, or their complements
where the sign is minus, are added to the score's slices by carry-save adders over bitmaps, all rows of a block at a time. The top rows
are taken from the score's most significant slice downward: rows with the bit set are in if they are at most what is still to be found,
else they alone stay in question. Rows that no slice parts are ties at the boundary, and the first of them in the order of vec_id
are taken. The sums are exact, so are the scores, which are read back from the slices.

The queries (rows of the index, in groups of GROUP) meet each block in a task of its own; each gives its best of the block, and
the best of these over all blocks are ranked. What a task holds is one block and one group. The driver gets the blocks' numbers alone:
8 bytes for as many as BLOCK rows.

A vector that is null, or holds a null or a component that is not finite, takes no part. A shorter vector counts as filled with
zeros. A null vec_id is no query, and the last of ties as a candidate. Each row whose vec_id is divisible is a query of its own, and
candidates are all rows but that row, so a repeated vec_id gives repeated ranks. Integers are held within vectors.MOST. An empty table
gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, narrow, ship, written
from lodestone.llm.vectors import integers, widened

SCALE = 64
TOP = 20
EVERY = 20
#: Rows of a block, and queries that meet it at a time.
BLOCK, GROUP = 16_384, 256
#: Bytes of the bitmaps of one power that are added at a time, about.
AT_ONCE = 600_000
INDEX = "block long, size int, vec_ids array<bigint>, low array<bigint>, bits array<int>, slices binary"
GROUPS = "home long, part int, places array<int>, query_ids array<bigint>, width int, weights binary"
FOUND = "home long, place int, query_id long, vec_id long, score long"


def sliced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least of each column, bits that the rest takes, bitmaps [bit, column, word] of the rows)."""
    low = x.min(axis=0)
    rest = x - low
    bits = np.frexp(rest.max(axis=0).astype(np.float64))[1].astype(np.int32)
    n, width = x.shape
    out = np.zeros((int(bits.max(initial=0)), width, -(-n // 64) * 8), np.uint8)
    for b in range(len(out)):
        out[b, :, : -(-n // 8)] = np.packbits((rest >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
    return low, bits, out.view(np.uint64)


def rows_at(slices: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What stands in the rows of these places: numbers of the last axis but one's bitmaps, by the first axis' bits."""
    on = slices[..., places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)
    return (on.astype(np.int64) << np.arange(len(slices)).reshape(len(slices), *[1] * (on.ndim - 1))).sum(axis=0)


def signed_digits(weights: np.ndarray) -> np.ndarray:
    """[power, query, attribute]: digits -1, 0, 1 of which no two neighbours are both other than 0."""
    out, left = [], weights.copy()
    while left.any():
        digit = (left & 1) * (2 - (left & 3))
        out.append(digit.astype(np.int8))
        left = (left - digit) >> 1
    return np.array(out, np.int8).reshape(len(out), *weights.shape)


def added(bitmaps: np.ndarray, which: np.ndarray, key: np.ndarray, sums: int, powers: int) -> np.ndarray:
    """[sum, power, word]: the slices of several sums, of 2^p times bitmaps[which] each, where key is p * sums + the sum's number.

    Carry-save adders take three bitmaps of a power at a time, for all sums in one go; the last bitmap, which is empty, fills up
    the sums that have fewer.
    """
    which = which[np.argsort(key, kind="stable")]
    counts = np.bincount(key, minlength=powers * sums)
    place = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    counts = counts.reshape(powers, sums)
    ends, most = np.cumsum(counts.sum(axis=1)), counts.max(axis=1)
    out = np.empty((sums, powers, bitmaps.shape[1]), np.uint64)
    carried = []
    for p in range(powers):
        table = np.full((sums, int(most[p])), len(bitmaps) - 1)
        own = slice(ends[p - 1] if p else 0, ends[p])
        table[np.repeat(np.arange(sums), counts[p]), place[own]] = which[own]
        x = np.concatenate([bitmaps[table], *carried], axis=1) if carried else bitmaps[table]
        carried = []
        while x.shape[1] > 2:
            k = x.shape[1] // 3
            a, b, c = x[:, :k], x[:, k : 2 * k], x[:, 2 * k : 3 * k]
            either = a ^ b
            both = a & b
            both |= either & c
            carried.append(both)
            either ^= c
            x = np.concatenate([either, x[:, 3 * k :]], axis=1) if x.shape[1] > 3 * k else either
        if x.shape[1] == 2:
            carried.append(x[:, :1] & x[:, 1:])
            x = x[:, :1] ^ x[:, 1:]
        out[:, p] = x[:, 0] if x.shape[1] else 0
    return out


def set_places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def highest(scores: np.ndarray, among: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the `most` highest rows of among[k] by the slices scores[k], ties to the lower place."""
    inside, chosen = np.zeros_like(among), np.zeros(len(among), np.int64)
    for p in reversed(range(scores.shape[1])):
        high = among & scores[:, p]
        n = np.bitwise_count(high).sum(axis=1, dtype=np.int64)
        over = chosen + n > most
        inside = np.where(over[:, None], inside, inside | high)
        among = np.where(over[:, None], high, among & ~scores[:, p])
        chosen += np.where(over, 0, n)
    return [np.concatenate([set_places(i), set_places(a)[: most - n]]) for i, a, n in zip(inside, among, chosen.tolist())]


class Block:
    """One block of the index, ready for queries."""

    def __init__(self, size: int, low: np.ndarray, bits: np.ndarray, slices: bytes):
        self.size, self.low, self.bits, width, words = size, low, bits, len(low), -(-size // 64)
        self.depth = int(bits.max(initial=0))
        own = np.frombuffer(slices, np.uint64).reshape(self.depth * width, words)
        self.bitmaps = np.concatenate([own, ~own, np.zeros((1, words), np.uint64)])
        self.all = np.full(words, ~np.uint64(0))
        if size & 63:
            self.all[-1] = np.uint64((1 << (size & 63)) - 1)

    def search(self, weights: np.ndarray, without: np.ndarray | None, most: int):
        """(places, scores) of the best rows for each row of weights; `without`: a place for each that is no candidate."""
        width = len(self.low)
        weights = weights[:, :width] if weights.shape[1] > width else widened(weights, width)
        digits, level = signed_digits(weights), np.arange(self.depth)
        spans = (1 << self.bits.astype(np.int64)) - 1
        base = weights @ self.low
        for p, digit in enumerate(digits):
            base -= ((digit < 0) @ spans) << p
        powers = len(digits) + self.depth + (width * max(1, len(digits))).bit_length()  # a sum of so many terms has no further bit
        step = max(1, AT_ONCE // (8 * self.bitmaps.shape[1] * max(1, width)))
        for k in range(0, len(weights), step):
            power, q, at = np.nonzero(digits[:, k : k + step])
            sums = len(weights[k : k + step])
            minus = digits[power, k + q, at] < 0
            there = level[None, :] < self.bits[at][:, None]
            which = ((minus[:, None] * self.depth + level) * width + at[:, None])[there]
            scores = added(self.bitmaps, which, ((power[:, None] + level) * sums + q[:, None])[there], sums, powers)
            among = np.repeat(self.all[None], sums, axis=0)
            if without is not None:
                own = without[k : k + sums]
                among[np.arange(sums), own >> 6] &= ~(np.uint64(1) << (own & 63).astype(np.uint64))
            for j, places in enumerate(highest(scores, among, most)):
                yield places, base[k + j] + rows_at(scores[j], places)


def index(vectors: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Rows of INDEX over vectors (vec_id, embedding), written to the shared folder."""
    bounded_batches(vectors.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task, made, held, waiting = TaskContext.get().partitionId() << 32, 0, [], 0

        def packed():
            nonlocal made, held, waiting
            width = max(x.shape[1] for _, x in held)
            ids, x = pa.concat_arrays([i for i, _ in held]), np.concatenate([widened(x, width) for _, x in held])
            order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            while len(order) >= block or (len(order) and final):
                now, order = order[:block], order[block:]
                low, bits, slices = sliced(x[now])
                yield pa.RecordBatch.from_pylist([{"block": task + made, "size": len(now), "vec_ids": ids.take(pa.array(now)), "low": low, "bits": bits, "slices": slices.tobytes()}], schema=kind)
                made += 1
            held, waiting = ([(ids.take(pa.array(order)), x[order])], len(order)) if len(order) else ([], 0)

        kind = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("vec_ids", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("bits", pa.list_(pa.int32())), ("slices", pa.binary())])
        final = False
        for batch in batches:
            places, x = integers(batch.column(1), scale)
            if len(places):
                held.append((batch.column(0).cast(pa.int64()).take(pa.array(places)), x))
                waiting += len(places)
            if waiting >= block:
                yield from packed()
        final = True
        if held:
            yield from packed()

    return written(narrow(vectors, "vec_id", "embedding").mapInArrow(run, INDEX))


def query_groups(blocks: DataFrame, every: int = EVERY, group: int = GROUP) -> DataFrame:
    """Rows of GROUPS: the rows of the index whose vec_id is divisible by `every`, read back from its slices."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chosen = [k for k, i in enumerate(row["vec_ids"]) if i is not None and i % every == 0]
                width, words = len(row["low"]), -(-row["size"] // 64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(max(row["bits"], default=0), width, words)
                for part, k in enumerate(range(0, len(chosen), group)):
                    now = chosen[k : k + group]
                    x = rows_at(slices, np.array(now)) + np.array(row["low"], np.int64)[:, None]
                    yield pa.RecordBatch.from_pydict({"home": [row["block"]], "part": pa.array([part], pa.int32()), "places": pa.array([now], pa.list_(pa.int32())), "query_ids": [[row["vec_ids"][p] for p in now]], "width": pa.array([width], pa.int32()), "weights": [np.ascontiguousarray(x.T).tobytes()]})

    return blocks.mapInArrow(run, GROUPS)


def top_rows(vectors: DataFrame, most: int = TOP, every: int = EVERY, scale: int = SCALE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the `most` highest inner products of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    blocks = index(vectors, scale, block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a whole block from here on
    groups = written(query_groups(blocks, every, group))
    numbers = {r.block: k for k, r in enumerate(blocks.select("block").sort("block").collect())}
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, min(groups.count(), -(-4 * tasks // max(1, len(numbers)))))
    n = max(1, min(slots * len(numbers), 64 * tasks))
    cell = lambda number, slot: (number * slots + slot).alias("cell")
    number = spark.createDataFrame(list(numbers.items()), "block long, number long")
    left = blocks.join(F.broadcast(number), "block").select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).select(*blocks.columns, cell(F.col("number"), F.col("slot")))
    spread = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(numbers) - 1)))).alias("number"))
    right = spread.select(*groups.columns, cell(F.col("number"), F.pmod(F.xxhash64("home", "part"), F.lit(slots))))
    met = left.repartition(n, "cell").hint("merge").join(right.repartition(n, "cell"), "cell").drop("cell")

    def run(batches):
        known, ready, ids = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != known:
                    known, ready, ids = row["block"], Block(row["size"], np.array(row["low"], np.int64), np.array(row["bits"], np.int32), row["slices"]), row["vec_ids"]
                places = np.array(row["places"])
                weights = np.frombuffer(row["weights"], np.int64).reshape(len(places), row["width"])
                out = [[], [], [], []]
                for q, (at, scores) in enumerate(ready.search(weights, places if row["home"] == known else None, most)):
                    for column, values in zip(out, ([row["places"][q]] * len(at), [row["query_ids"][q]] * len(at), [ids[p] for p in at.tolist()], scores.tolist())):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array([row["home"]] * len(out[0]), pa.int64()), pa.array(out[0], pa.int32()), *[pa.array(c, pa.int64()) for c in out[1:]]], names=[c.split()[0] for c in FOUND.split(", ")])

    found = written(met.mapInArrow(run, FOUND))
    bounded_batches(spark)
    best = Window.partitionBy("home", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with kept as materialized (
    select row_number() over () as place, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.place, q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, 1 + least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) as bigint) as score
    from kept q join kept c on q.place <> c.place
    where q.vec_id % 20 = 0),
ranked as (
    select *, cast(row_number() over (partition by place order by score desc, vec_id nulls last) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

ship(__name__)
