"""Exact self-join of documents on word n-grams at a Jaccard similarity, by universe partition and pigeonhole.

Sets of hashed shingles fall into size bands. Two sets whose smaller one is in a band differ in at most H
shingles; the universe is dealt by hash into H + 1 segments, so that some segment is the same in both. The
signatures of a set are its segments' sums. Allocation is by cost:

* A segment with fewer than two shingles is skipped, as most sets would share it. Every skipped segment is paid
  for with one segment's one-deletion neighbourhood (the segment with each shingle left out), in the order of
  segments: if two sets have e such segments in common and share no other, then of any e other segments one
  differs by exactly one shingle, so that one's neighbourhood holds the other or its neighbour.
* A set that has too few segments to pay with also gives its prefix of lowest shingles (Jaccard prefix filter) as
  signatures, which finds the pairs of two such sets.
* A set is indexed in its own band, and in the band below if sets there can be similar to it.

Sets that are equal are one node from the start, named by its least doc_id. Groups of nodes with a signature in common
are then checked exactly, on whole sets, without making all pairs:

* In a round each node is checked against a few nodes of other components that share groups with it, the smallest
  groups first, and components are put together.
* Nodes that the rounds leave apart in some group are allocated anew, by counted cost: a table of SLOTS counters has how
  many sets hold the shingles of each slot, and a set's signatures are its cheapest shingles, as many as a similar set
  must share one of. Nodes meet only over one of these, so that groups that a frequent passage, line or segment has
  brought together fall apart; what is left are sets that are similar in the most part. Their sizes, and bitmaps in which
  every shingle turns one of 512 bits (sets differ in at least as many shingles as their bitmaps in bits), show which pairs
  can't be similar. No candidate is dropped otherwise.

Nulls, empty texts and texts without words have empty sets, and are linked with nothing; texts of fewer words than
a shingle are one shingle; repeated rows are nodes' copies; an empty table gives no rows; other columns are ignored.
Each row of a null doc_id is a document of its own, after all others in order; texts that share a doc_id are told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.llm.common import blocks, bounded_batches, column_bytes, fresh, lower_table, mix, narrow, numbered, partitions_for, ship, space_words, word_hashes, words_of, written

WORDS, PERCENT = 5, 80
#: Checks of a node in each round, before what is left is allocated by counted cost.
ROUNDS = (1, 8)
#: Counters of shingles; a part of them is summed by one task. The table that workers get has a byte for each.
SLOTS, PARTS = 1 << 20, 64
#: 64-bit words of a set's bitmap that goes with its groups, and of the one that pairs are looked up in.
BITS, WIDE = 8, 64
#: Groups of a node that a row of it goes with, so that pairs are not made again in each group that they share.
EARLIER = 16
SMALL = 2
#: Buckets of signatures for each partition of the documents; a worker sorts one.
BUCKETS = 2
_G = np.uint64(0x9E3779B97F4A7C15)


def band_starts(percent: int, ratio: float = 1.6, top: int = 1 << 40) -> list[int]:
    """The least sizes of the bands; a set and one that is similar to it are at most a band apart."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, int(out[-1] * max(ratio, 100 / percent + 0.05))))
    return out


def segments_of(largest: int, percent: int) -> int:
    """H + 1 for pairs whose smaller set has up to `largest` shingles."""
    both = largest + largest * 100 // percent
    return both * (100 - percent) // (100 + percent) + 1


class Shingles:
    """Distinct shingles of documents, as sorted arrays of hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.lower, self.is_word = words, lower_table(), space_words()

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        data, k, n = self.lower[data], self.words, len(bounds) - 1
        starts, ends, doc = words_of(data, bounds, self.is_word)
        if not len(starts):
            return [np.zeros(0, np.uint64)] * n
        w = word_hashes(data, starts, ends)
        at = np.searchsorted(doc, np.arange(n + 1)).tolist()
        with np.errstate(over="ignore"):
            s = np.zeros(max(len(w) - k + 1, 0), np.uint64)
            for i in range(k):
                s = mix(s * np.uint64(3) + w[i : len(w) - k + 1 + i]) if len(s) else s
            out = []
            for a, b in zip(at[:-1], at[1:]):
                if b - a >= k:
                    out.append(np.unique(s[a : b - k + 1]))
                else:
                    x = np.full(min(b - a, 1), b - a, np.uint64)
                    for i in range(a, b):
                        x = mix(x * np.uint64(5) + w[i])
                    out.append(x)
        return out


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes of each set."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), 2), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        flat, at = np.concatenate([sets[i] for i in some]), np.cumsum(size[some]) - size[some]
        with np.errstate(over="ignore"):
            for k in range(2):
                out[some, k] = mix(np.add.reduceat(mix(flat + _G * np.uint64(k + 11)), at) + size[some].astype(np.uint64))
    return out.view(np.int64)


def signatures(u: np.ndarray, percent: int, starts: list[int]) -> np.ndarray:
    """The signatures of a set in its bands."""
    n = len(u)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    out = []
    for band in (own, own - 1):
        if band < 0 or (band < own and n > (starts[band + 1] - 1) * 100 // percent):
            continue
        m = segments_of(starts[band + 1] - 1, percent)
        if m == 1:  # only equal sets
            continue
        with np.errstate(over="ignore"):
            salt = mix(np.full(1, band + 1, np.uint64) * _G)
            segment = (mix(u ^ salt) >> np.uint64(11)) % np.uint64(m)
            order = np.argsort(segment, kind="stable")
            segment, value = segment[order], mix(u[order] + _G)
            at = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            size, name = np.diff(np.append(at, n)), segment[at]
            total = np.add.reduceat(value, at) + mix(name * _G + salt)
            large = size >= SMALL
            owed = m - int(large.sum())
            paid = np.zeros(len(at), bool)
            if owed:
                have = np.cumsum(large)
                paid[: int(np.searchsorted(have, owed)) + 1] = True
            out.append(mix(total[large | paid]))
            if owed:
                each = np.repeat(paid & large, size)
                out.append(mix((np.repeat(total, size) - value)[each]))
                if owed > int(large.sum()):
                    out.append(mix(u[: n - -(-n * percent // 100) + 1] + salt * np.uint64(7)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles), h1, h2 (hashes of the set)."""

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            sizes, hashes = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
            for i, j in blocks(offsets):
                sets = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sizes.append(np.array([len(s) for s in sets]))
                hashes.append(set_hashes(sets))
            hashes = np.concatenate(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(sizes)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["doc_id", "n", "h1", "h2"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long")


def _dealt(sig: np.ndarray, node: np.ndarray, n: int) -> pa.RecordBatch:
    """A row (bucket, payload) for each bucket, of the signatures dealt to it and their nodes."""
    bucket = (sig >> np.uint64(24)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    sig, node, edge = sig[order], node[order], np.searchsorted(bucket[order], np.arange(n + 1))
    full = np.flatnonzero(np.diff(edge)).tolist()
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([sig[edge[k] : edge[k + 1]].tobytes() + node[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())], names=["bucket", "payload"])


def _dealt_signatures(docs: DataFrame, words: int, percent: int, n: int) -> DataFrame:
    """Rows (bucket, payload) of signatures and the nodes that have them; equal sets of a batch give theirs once."""
    starts = band_starts(percent)

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            seen, sigs, nodes = set(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in blocks(offsets):
                sets = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for s, h in zip(sets, set_hashes(sets)[:, 0].tolist()):
                    if len(s) and h not in seen:
                        seen.add(h)
                        sigs.append(signatures(s, percent, starts))
                        nodes.append(np.full(len(sigs[-1]), h))
            yield _dealt(np.concatenate(sigs), np.concatenate(nodes), n)

    return narrow(docs, "doc_id", "text").mapInArrow(run, "bucket int, payload binary")


def shared_groups(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, node) of the groups of two nodes or more with a signature in common; groups of the same nodes are one."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(sig)))
    keep = np.repeat(size > 1, size)
    node, size = node[keep], size[size > 1]
    if not len(node):
        return node, node
    at = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        name = mix(np.add.reduceat(mix(node.view(np.uint64) + _G), at) + size.astype(np.uint64))
    _, first = np.unique(name, return_index=True)
    keep = np.zeros(len(name), bool)
    keep[first] = True
    keep = np.repeat(keep, size)
    return np.repeat(name, size)[keep].view(np.int64), node[keep]


def _groups(dealt: DataFrame) -> DataFrame:
    def run(batches):
        parts = [p for batch in batches for p in batch.column(1).to_pylist()]
        sig = np.concatenate([np.frombuffer(p, np.uint64, len(p) // 16) for p in parts]) if parts else np.zeros(0, np.uint64)
        node = np.concatenate([np.frombuffer(p, np.int64, offset=len(p) // 2) for p in parts]) if parts else np.zeros(0, np.int64)
        name, node = shared_groups(sig, node)
        for k in range(0, max(len(name), 1), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(name[k : k + 100_000], pa.int64()), pa.array(node[k : k + 100_000], pa.int64())], names=["grp", "node"])

    return dealt.mapInArrow(run, "grp long, node long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component; edges (a, b) both ways are one. Lowest labels spread and jump."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        labels = written(labels)
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = spread.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
        step = written(spread.join(jump, F.col("label") == F.col("_at"), "left").select("node", "was", F.coalesce("_to", "label").alias("label")))
        if step.filter("was <> label").isEmpty():
            return labels
        labels = step.select("node", "label")


def bitmaps(sets: list[np.ndarray], words: int = BITS) -> np.ndarray:
    """For each set, `words` 64-bit words, in which each shingle turns one bit."""
    out = np.zeros((len(sets), words), np.int64)
    for k, s in enumerate(sets):
        bit = np.flatnonzero(np.bincount((s >> np.uint64(13)) % np.uint64(64 * words), minlength=64 * words) & 1)
        np.bitwise_or.at(out[k], bit >> 6, (np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))
    return out


def _maybe(bits: str, n: str, other_bits: str, other_n: str, percent: int) -> str:
    """Whether sets of these sizes and bitmaps can be similar."""
    differ = " + ".join(f"bit_count({bits}.b{k} ^ {other_bits}.b{k})" for k in range(BITS))
    return f"100 * least({n}, {other_n}) >= {percent} * greatest({n}, {other_n}) and {100 + percent} * ({differ}) <= {100 - percent} * ({n} + {other_n})"


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose whole sets are similar; wide bitmaps show of most others that they aren't."""
    wide = lambda side: sets.select(F.col("node").alias(side), F.size("shingles").alias(f"_n{side}"), F.col("wide").alias(f"_w{side}"))
    whole = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"_s{side}"))
    differ = F.aggregate(F.zip_with("_wa", "_wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    maybe = pairs.join(wide("a"), "a").join(wide("b"), "b").filter((100 + percent) * differ <= (100 - percent) * (F.col("_na") + F.col("_nb")))
    common = F.size(F.array_intersect("_sa", "_sb"))
    return maybe.select("a", "b", "_na", "_nb").join(whole("a"), "a").join(whole("b"), "b").filter(100 * common >= percent * (F.col("_na") + F.col("_nb") - common)).select("a", "b")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(17)) % np.uint64(SLOTS)


def shingle_costs(sets: DataFrame) -> np.ndarray:
    """For each slot the logarithm, in eighths of a power of 2, of the number of sets that hold its shingles: SLOTS bytes, whatever the sets."""

    def count(batches):
        out = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            out += np.bincount(_slots(batch.column(0).flatten().to_numpy()), minlength=SLOTS).astype(np.uint32)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(out, PARTS)], pa.binary())], names=["part", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(counts, np.uint32).astype(np.uint64)
                sums[part] = sums[part] + own if part in sums else own
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(8 * np.log2(own + np.uint64(1)), 255).astype(np.uint8).tobytes()], pa.binary())], names=["part", "costs"])

    rows = sets.select("shingles").mapInArrow(count, "part int, counts binary").repartition(PARTS, "part").mapInArrow(total, "part int, costs binary").collect()  # PARTS rows
    return np.frombuffer(b"".join(r.costs for r in sorted(rows)) or bytes(SLOTS), np.uint8)


def _dealt_cheapest(sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Rows (bucket, payload) of each node's cheapest shingles, as many as a set that is similar to it must share one of."""
    sent = sets.sparkSession.sparkContext.broadcast(shingle_costs(sets))

    def run(batches):
        costs = sent.value
        for batch in batches:
            node, lists = batch.column(0).to_numpy(), batch.column(1)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            picked = [np.zeros(0, np.int64)]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = flat[a:b]
                picked.append(own[np.lexsort((own, costs[_slots(own)]))[: b - a + 1 - -(-(b - a) * percent // 100)]])
            yield _dealt(np.concatenate(picked).view(np.uint64), np.repeat(node, [len(x) for x in picked[1:]]), n)

    return sets.select("node", "shingles").mapInArrow(run, "bucket int, payload binary")


def link_nodes(groups: DataFrame, sets: DataFrame, percent: int, rounds: tuple[int, ...] = ROUNDS) -> DataFrame | None:
    """(node, label) of the nodes that are linked, from groups (grp, node, n, bits); None if none are."""
    n = partitions_for(sets)
    labels, tested = None, None
    for k in range(len(rounds) + 1):
        now = groups.withColumn("comp", F.col("node")) if labels is None else groups.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        apart = now.groupBy("grp").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_size"), F.min_by(F.struct("node", "comp", "n", "bits"), F.xxhash64("node", F.lit(k))).alias("_c")).filter("_lo <> _hi").select("grp", "_c", "_size")
        if k < len(rounds):
            pairs = now.join(apart, "grp").filter("comp <> _c.comp").filter(_maybe("bits", "n", "_c.bits", "_c.n", percent))
            pairs = pairs.groupBy("node", F.col("_c.node").alias("other")).agg(F.min("_size").alias("_size"))
            if tested is not None:
                pairs = pairs.withColumns({"a": F.least("node", "other"), "b": F.greatest("node", "other")}).join(tested, ["a", "b"], "left_anti")
            best = Window.partitionBy("node").orderBy("_size", F.xxhash64("other", F.lit(k)), "other")
            pairs = pairs.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= rounds[k])
        else:
            members = written(now.join(apart.select("grp"), "grp").select("node", "comp", "n", "bits").dropDuplicates(["node"]))
            pairs = rare_pairs(members, sets, percent, n)
        pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        links = written(similar(pairs, sets, percent))
        if links.isEmpty():
            continue
        if labels is None:
            labels = components(links)
        else:
            of = labels.select(F.col("node"), F.col("label"))
            a = links.join(of, F.col("a") == F.col("node"), "left").select(F.coalesce("label", "a").alias("a"), "b")
            over = a.join(of, F.col("b") == F.col("node"), "left").select("a", F.coalesce("label", "b").alias("b")).filter("a <> b").distinct()
            higher = written(components(over))
            up = higher.select(F.col("node").alias("_at"), F.col("label").alias("_to"))
            old = labels.join(up, F.col("label") == F.col("_at"), "left").select("node", F.coalesce("_to", "label").alias("label"))
            labels = written(old.union(higher.join(labels.select("node"), "node", "left_anti").select("node", "label")))
    return labels


def rare_pairs(members: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs (node, other) of members (node, comp, n, bits) that are apart, share one of their cheapest shingles and may be similar.

    Each row goes with its node's last EARLIER groups before it: a pair that shares one of these has met there, or in one before, and
    is not made again. So sets that share many of their cheapest shingles meet about once, and always in the first group of both.
    """
    before = Window.partitionBy("node").orderBy("grp").rowsBetween(-EARLIER, -1)
    found = _groups(_dealt_cheapest(sets, percent, n).repartition(n, "bucket")).distinct().join(members, "node").withColumn("earlier", F.collect_list("grp").over(before))
    sizes = found.groupBy("grp", "comp").count().groupBy("grp").agg(F.max_by("comp", F.struct("count", "comp")).alias("_most"), F.count("*").alias("_comps"))
    found = found.join(sizes.filter("_comps > 1").select("grp", "_most"), "grp")  # a group's largest component is not compared with itself
    right = found.select("grp", F.col("node").alias("other"), F.col("comp").alias("_comp"), F.col("n").alias("_n"), F.col("bits").alias("_bits"), F.col("earlier").alias("_earlier"))
    pairs = found.filter("comp <> _most").join(right, "grp").filter("comp <> _comp and (_comp = _most or node < other)")
    return pairs.filter(f"{_maybe('bits', 'n', '_bits', '_n', percent)} and not arrays_overlap(earlier, _earlier)").select("node", "other")


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates of docs whose doc_id is never null and has one text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = BUCKETS * partitions_for(docs)
    each = written(document_sets(docs, words))
    nodes = written(each.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
    groups = _groups(_dealt_signatures(docs, words, percent, n).repartition(n, "bucket")).distinct()
    # sets of one h1 that h2 tells apart are both put into its groups
    groups = written(groups.join(nodes.select(F.col("h1").alias("node"), "rep", "n"), "node").select("grp", F.col("rep").alias("node"), "n"))
    bits = [f"b{k}" for k in range(BITS)]

    def run(batches):
        shingles, seen = Shingles(words), set()
        for batch in batches:
            fresh_rows = [k for k, x in enumerate(batch.column(0).to_pylist()) if not (x in seen or seen.add(x))]  # a row that is repeated gives its set once
            batch = batch.take(pa.array(fresh_rows, pa.int32()))
            data, offsets = column_bytes(batch.column(1))
            sets = [s for i, j in blocks(offsets) for s in shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            for k in range(0, len(sets), 200):
                own = sets[k : k + 200]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 200], pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own).view(np.int64))), pa.array(list(bitmaps(own, WIDE)), pa.list_(pa.int64())), *map(pa.array, np.ascontiguousarray(bitmaps(own).T))], names=["node", "shingles", "wide", *bits])

    texts = narrow(docs, "doc_id", "text").join(groups.select("node").distinct(), F.col("doc_id") == F.col("node"))
    sets = written(texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>, wide array<long>, " + ", ".join(f"{b} long" for b in bits)))
    groups = written(groups.join(sets.select("node", F.struct(*bits).alias("bits")).dropDuplicates(["node"]), "node"))
    labels = link_nodes(groups, sets.select("node", "shingles", "wide"), percent)
    if labels is not None:  # the least node of a component is its least doc_id
        nodes = nodes.join(labels, F.col("rep") == F.col("node"), "left").withColumn("rep", F.coalesce("label", "rep"))
    of = written(nodes.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "rep"))
    found = each.join(of, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to, null if they only lead to nulls) of each document."""
    told = numbered(docs)
    if told is None:
        return _linked(docs, words, percent)
    rows = told[0].select(F.col(told[1]).alias("row"), "doc_id", "text")
    found = _linked(rows.select(F.col("row").alias("doc_id"), "text"), words, percent).withColumnsRenamed({"doc_id": "own", "component_id": "least"})
    ids = rows.select("row", "doc_id").distinct()
    own, least = ids.withColumnRenamed("row", "own"), ids.select(F.col("row").alias("least"), F.col("doc_id").alias("component_id"))
    return found.join(own, "own").join(least, "least").select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without near duplicates: of each component, the document with the least doc_id stays (once, if its row is repeated).

    Of texts that share this doc_id the one with the least hash stays; a null doc_id stays if the component has no other.
    """
    own, key = numbered(docs) or (docs, "doc_id")
    gone = fresh(own, "_kept")
    kept = _linked(own.select(F.col(key).alias("doc_id"), "text"), words, percent).filter("doc_id = component_id").select(F.col("doc_id").alias(gone)).distinct()
    return own.join(kept, F.col(key) == F.col(gone), "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ship(__name__)
