"""Near duplicates by SimHash fingerprints and a self-join of their binary trie.

Fingerprints are 64 bits wide. Two fingerprints link if they differ in at most BUDGET bits. The join walks pairs
of trie nodes together, adds up the bits in which their prefixes differ, and leaves a pair as soon as the sum
is over the budget.

How the walk is dealt out: the fingerprint is four blocks of 16 bits, and of two fingerprints that differ in at
most two bits, at least two blocks are equal. In each of the six bit orders that put two blocks first, the trie
is entered at depth 32 at the node pairs (node, node) without differences; every link is below one of them. A
node pair is a task; if more than MAX_LEAVES fingerprints are below it, Spark replaces it by the pairs of its
descendants eight levels below that keep within the budget, again and again, so no task grows with the corpus.
All that is dealt out are distinct fingerprints, so copies cost nothing here. Where documents meet their fingerprint's
class, or fingerprints their component's root, keys with more rows than HOT are joined without shuffling those rows.

Edge cases: null and wordless texts have fingerprint zero and link like any other. Repeated rows come out once
each. A null doc_id is kept and never names a component unless all its documents have none. Any other columns
of the input are ignored by `near_duplicates` and kept by `keep_one`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import HOT, arrow_map, binary_list, cut, join_hot, pieces, schema_with, session, table

SHINGLE_WORDS = 3
SEED = 42
BUDGET = 2
MAX_LEAVES = 200_000
#: So many ids of 8 bytes may go to every task.
SMALL_IDS = 1_000_000
#: Of so many links, 16 bytes each, one task finds the components; of more, rounds of joins do.
ONE_TASK = 500_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
#: Block numbers, first block first, of the six bit orders.
ORDERS = [(*two, *(k for k in range(4) if k not in two)) for two in combinations(range(4), 2)]


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """The 64 bits: 1 where over half of the shingles' hashes have a 1."""
    if not text:
        return 0
    ones, total, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_digest
    for part in pieces(text, _SPACE):
        words = carry + part.lower().split()
        if len(words) < width:
            carry = words
            continue
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - width + 1].tolist()
        hashes = b"".join([digest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(starts)
        carry = words[len(words) - width + 1 :]
    if not total and carry:
        ones, total = np.unpackbits(np.frombuffer(digest(b" ".join(carry), SEED), np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """The kept columns and __fp, the fingerprint as a signed long."""
    source = docs.select(*keep, F.col(text).alias("__body"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([fingerprint(t, width) for t in binary_list(batch.column(len(keep)))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(prints)], names=[*keep, "__fp"])

        return step

    return arrow_map(source, make, schema_with(source, keep, "__fp long"))


def _turned(fp: Column, order: tuple[int, ...]) -> Column:
    """fp with its blocks in this order."""
    out = F.lit(0).cast("long")
    for place, block in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 48 - 16 * block).bitwiseAND(F.lit(0xFFFF)), 48 - 16 * place))
    return out


def _turned_back(value: int, order: tuple[int, ...]) -> int:
    out = 0
    for place, block in enumerate(order):
        out |= ((value >> (48 - 16 * place)) & 0xFFFF) << (48 - 16 * block)
    return out


def trie_pairs(left: list[int], right: list[int] | None, spent: int, below: int, budget: int = BUDGET) -> Iterator[tuple[int, int]]:
    """Pairs within the budget of two trie nodes, or of one with itself (right is None).

    left and right: the sorted distinct leaves; spent: differences of the bits from `below` upwards.
    Nodes are ranges of the sorted leaves. Levels at which neither range branches are passed in one step.
    """
    other = left if right is None else right
    if not left or not other:
        return
    stack = [(0, len(left), 0, len(other), below, spent, right is None)]
    while stack:
        a, b, c, d, level, cost, same = stack.pop()
        if same:
            if b - a < 2:
                continue
            level = (left[a] ^ left[b - 1]).bit_length()
            middle = bisect_left(left, (left[b - 1] >> (level - 1)) << (level - 1), a, b)
            stack += [(a, middle, a, middle, level - 1, cost, True), (middle, b, middle, b, level - 1, cost, True)]
            if cost < budget:
                stack.append((a, middle, middle, b, level - 1, cost + 1, False))
            continue
        branch = max((left[a] ^ left[b - 1]).bit_length(), (other[c] ^ other[d - 1]).bit_length())
        cost += (((left[a] ^ other[c]) & ((1 << level) - 1)) >> branch).bit_count()
        if cost > budget:
            continue
        if not branch:
            yield left[a], other[c]
            continue
        bit = branch - 1
        halves = []
        for leaves, lo, hi in ((left, a, b), (other, c, d)):
            middle = bisect_left(leaves, ((leaves[lo] >> branch) << branch) | (1 << bit), lo, hi)
            halves.append(((lo, middle), (middle, hi)))
        for x in (0, 1):
            for y in (0, 1):
                (a1, b1), (c1, d1) = halves[0][x], halves[1][y]
                if a1 < b1 and c1 < d1 and cost + (x != y) <= budget:
                    stack.append((a1, b1, c1, d1, bit, cost + (x != y), False))


def _walk(batches: Iterable[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by task: the links of each task."""
    key, sides = None, ([], [])
    found: list[tuple[int, int]] = []

    def done() -> None:
        if key is not None and (len(sides[0]) > 1 or sides[1]):
            order, cross, depth, spent = ORDERS[key[0]], key[1] != key[2], key[3], key[4]
            for x, y in trie_pairs(sides[0], sides[1] if cross else None, spent, 64 - depth, budget):
                found.append((_turned_back(x, order), _turned_back(y, order)))

    def out() -> pa.RecordBatch:
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(7)]
        for order, ta, tb, depth, spent, side, value in zip(*columns, strict=True):
            if (now := (order, ta, tb, depth, spent)) != key:
                done()
                key, sides = now, ([], [])
            sides[side].append(value & 0xFFFFFFFFFFFFFFFF)
        if len(found) > 10_000:
            yield out()
    done()
    if found:
        yield out()


_TASK = ["ord", "ta", "tb", "depth", "spent"]


def _descend(rows: DataFrame, budget: int) -> DataFrame:
    """Node pairs replaced by the pairs of their descendants eight levels below."""
    masks = sorted((m for m in range(256) if m.bit_count() <= budget), key=lambda m: (m.bit_count(), m))
    mask = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("n")) for m in masks)))
    own = F.expr("shiftrightunsigned(shiftleft(p, depth), 56)")
    grown = rows.select("*", mask.alias("x"), own.alias("own")).where(F.col("spent") + F.col("x.n") <= budget)
    partner = F.col("own").bitwiseXOR(F.col("x.m"))
    same = F.col("ta") == F.col("tb")
    under = lambda node, bits: F.shiftleft(node, 8).bitwiseOR(bits)
    first = F.when(same, F.col("own") <= partner).otherwise(F.col("side") == 0)
    return grown.select(
        "ord",
        F.when(first, under("ta", F.col("own"))).otherwise(under("ta", partner)).alias("ta"),
        F.when(first, under("tb", partner)).otherwise(under("tb", F.col("own"))).alias("tb"),
        (F.col("depth") + 8).alias("depth"),
        (F.col("spent") + F.col("x.n")).alias("spent"),
        F.when(first, 0).otherwise(1).alias("side"),
        "p",
    )


def links(prints: DataFrame, budget: int = BUDGET, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints __fp that differ in at most `budget` (up to 2) bits."""
    if budget > 2:
        raise ValueError("four blocks prove completeness for budgets up to 2")
    turned = F.explode(F.array(*(F.struct(F.lit(k).alias("ord"), _turned(F.col("__fp"), o).alias("p")) for k, o in enumerate(ORDERS))))
    rows = prints.select(turned.alias("t")).select("t.ord", F.shiftrightunsigned("t.p", 32).alias("ta"), F.shiftrightunsigned("t.p", 32).alias("tb"), F.lit(32).alias("depth"), F.lit(0).alias("spent"), F.lit(0).alias("side"), "t.p")
    tasks = []
    while True:
        # A node pair with one leaf has no link; few remain, so the walk gets little to sort.
        sizes = rows.groupBy(*_TASK).agg(F.count("*").alias("n")).where("n > 1")
        rows = cut(rows.join(sizes, _TASK))
        tasks.append(rows.where(F.col("n") <= max_leaves).drop("n"))
        hot = rows.where(F.col("n") > max_leaves).drop("n")
        if hot.isEmpty():
            break
        rows = _descend(hot, budget)
    work = tasks[0]
    for more in tasks[1:]:
        work = work.unionByName(more)
    by_value = F.col("p").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    dealt = work.select(*_TASK, "side", "p").repartition(*(F.col(c) for c in _TASK)).sortWithinPartitions(*_TASK, "side", by_value)
    return dealt.mapInArrow(lambda batches: _walk(batches, budget), "a long, b long").distinct()


def _roots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node in the edges (u, v) of all batches."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        up = parent.setdefault(node, node)
        while up != node:
            parent[node] = up = parent[up]
            node, up = up, parent[up]
        return node

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            least, other = sorted((root(u), root(v)))
            parent[other] = least
    nodes = list(parent)
    for first in range(0, len(nodes), 50_000):
        some = nodes[first : first + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["node", "root"])


def components(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node in the pairs (a, b): root is the least node that can be reached.

    Large-star and small-star rounds; all edges stay distributed and each round is cut with checkpoint(). What has no more
    than one_task edges, at first or after a round, is joined up in one task, with the same result.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    sign = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = sign(edges)
    while True:
        if before[0] <= one_task:
            return cut(edges.coalesce(1).mapInArrow(_roots, "node long, root long"))
        # No key is hot as long as there are no more edges than a hot key has.
        join = join_hot if before[0] > HOT else lambda left, right, key: left.join(right.drop("__n"), key)
        near = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
        near = near.select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "__n")
        large = join(edges, near, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
        small = join(large, least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if (now := sign(edges)) == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _prints(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    session(docs.sparkSession)
    return cut(fingerprints(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")), ["__id"], "__text", width))


def _classes(prints: DataFrame, find) -> DataFrame:
    """Per distinct fingerprint: __root, __component (the least __id of its component), n_links and __n (its rows)."""
    classes = cut(prints.groupBy("__fp").agg(F.min("__id").alias("least"), F.count("*").alias("__n")))
    pairs = cut(find(classes.select("__fp")))
    roots = components(pairs)
    degree = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("__fp")).agg(F.count("*").alias("n_links"))
    joined = classes.join(roots.withColumnRenamed("node", "__fp"), "__fp", "left").join(degree, "__fp", "left")
    joined = cut(joined.select("__fp", "least", F.coalesce("root", "__fp").alias("__root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("__n").alias("rows")))
    names = joined.groupBy("__root").agg(F.min("least").alias("__component"), F.count("*").alias("__n"))
    return cut(join_hot(joined, names, "__root").select("__fp", "__root", "__component", "n_links", F.col("rows").alias("__n")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, n_links (other fingerprints that link to its own)."""
    prints = _prints(docs, doc_id, text, width)
    labelled = join_hot(prints, _classes(prints, lambda found: links(found, budget)), "__fp")
    return labelled.select(F.col("__id").alias(doc_id), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), F.col("__component").alias("component_id"), "n_links")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, budget: int = BUDGET) -> DataFrame:
    """docs without near duplicates: of each component the row with the least doc_id (of repeated rows, one)."""
    prints = _prints(docs, doc_id, text, width)
    return keep_least(docs, doc_id, text, prints, lambda found: links(found, budget), lambda rows, keep, body: fingerprints(rows, keep, body, width))


def keep_least(docs: DataFrame, doc_id: str, text: str, prints: DataFrame, find, label) -> DataFrame:
    """keep_one by any fingerprints: prints (__id, __fp), find(distinct ones) their links, label(rows, keep, text) adds __fp.

    Texts are only shuffled where the ids that go are more than SMALL_IDS.
    """
    labelled = cut(join_hot(prints, _classes(prints, find), "__fp"))
    first = F.col("__id").eqNullSafe(F.col("__component"))
    several = cut(prints.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1").select("__id"))
    gone = cut(labelled.where(~first).select("__id").union(several).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    one = lambda x, y: x["__id"].eqNullSafe(y["__id"])
    small = gone.count() <= SMALL_IDS
    plain = rows.join(F.broadcast(gone) if small else gone, one(rows, gone), "left_anti").select("__row.*")
    if several.isEmpty():
        return plain
    # Of an id with several rows, those that have the fingerprint to be kept; identical ones once.
    kept = labelled.where(first).groupBy("__root", "__id").agg(F.min("__fp").alias("__fp")).select("__id", "__fp")
    again = label(rows.join(F.broadcast(several) if small else several, one(rows, several), "left_semi"), ["__row", "__id"], "__text")
    again = again.join(kept, one(again, kept) & (again["__fp"] == kept["__fp"]), "left_semi")
    again = again.groupBy("__id", "__fp").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    return plain.unionByName(again.select("__row.*"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
