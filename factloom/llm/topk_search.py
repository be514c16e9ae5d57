"""Exact top-k search over binary codes by incremental multi-index hashing.

A code has one bit per dimension (1 where the value is positive) and is cut into m segments of about log2(n) bits. A
block of codes is indexed by each segment's value. For a query, segment after segment is probed at radius 0, then at
radius 1 and so on; once segments 0..j-1 have been probed at radius r and the others at r - 1, a code not found yet
differs in at least m*r + j bits. So the search of a query ends as soon as its k-th verified distance is below that:
nothing better, and no equal, can be missing. Where the probes of the next radius outnumber the codes of the block,
what is left of the block is compared directly, which is exact as well.

All codes are searched: queries and codes are dealt into blocks of bounded size, each pair of blocks is one task, and
the tasks' k best are merged. Equal codes are one entry with the k + 1 smallest ids (more can never be among the k
best), so copies cost nothing.

Results are ordered by distance, then by id; the query itself is left out. Edge cases: rows without an id or without
an embedding are neither queries nor neighbours; a null or NaN value is a 0 bit; embeddings of other lengths are
filled up with 0 bits; repeated rows count once; with fewer than k others, there are as many rows as others.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map, cut, session, table

K = 10
BLOCK_CODES = 16_384
BLOCK_QUERIES = 1_024
#: Every id divisible by this is a query.
QUERY_STEP = 20


def codes(rows: DataFrame, row_id: str, embedding: str) -> DataFrame:
    """__id and __code: the bits as bytes, filled up to whole 64-bit words."""
    source = rows.where(F.col(row_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(row_id).cast("long").alias("i"), F.col(embedding).cast("array<double>").alias("e"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for values in batch.column(1).to_pylist():
                bits = np.array([x is not None and x > 0 for x in values], bool)
                out.append(np.packbits(np.pad(bits, (0, -len(bits) % 64))).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["__id", "__code"])

        return step

    return arrow_map(source, make, "__id long, __code binary").where(F.octet_length("__code") > 0)


class Index:
    """Multi-index of one block: for each segment, the codes in the order of their values, and where a value begins."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        n, bits = len(words), words.shape[1] * 64
        m = max(1, round(bits / max(8, math.log2(max(n, 2)))), -(-bits // 20))
        edges = [bits * k // m for k in range(m + 1)]
        self.segments = list(zip(edges, edges[1:], strict=False))
        self.order, self.begin = [], []
        for (lo, hi), values in zip(self.segments, self.cut(words), strict=True):
            self.order.append(np.argsort(values, kind="stable"))
            self.begin.append(np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << (hi - lo))))))

    def cut(self, words: np.ndarray) -> list[np.ndarray]:
        """Each segment's values."""
        bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1).astype(np.int64)
        return [bits[:, lo:hi] @ (1 << np.arange(hi - lo - 1, -1, -1, dtype=np.int64)) for lo, hi in self.segments]

    def search(self, queries: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, code and distance of the k nearest codes of each query, ordered by distance and name."""
        n, m = len(self.words), len(self.segments)
        best_q = best_c = best_d = np.empty(0, np.int64)
        kth = np.full(len(queries), np.iinfo(np.int64).max)
        seen = np.zeros((len(queries), n), bool)
        values = self.cut(queries)

        def add(q: np.ndarray, c: np.ndarray) -> None:
            nonlocal best_q, best_c, best_d
            d = np.bitwise_count(queries[q] ^ self.words[c]).sum(axis=1, dtype=np.int64)
            close = d <= kth[q]
            best_q, best_c, best_d = (np.concatenate(x) for x in ((best_q, q[close]), (best_c, c[close]), (best_d, d[close])))
            order = np.lexsort((names[best_c], best_d, best_q))
            best_q, best_c, best_d = best_q[order], best_c[order], best_d[order]
            rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            kept = rank < k
            full = rank == k - 1
            kth[best_q[full]] = best_d[full]
            best_q, best_c, best_d = best_q[kept], best_c[kept], best_d[kept]

        for radius in range(max(hi - lo for lo, hi in self.segments) + 1):
            for j, (lo, hi) in enumerate(self.segments):
                active = np.flatnonzero(kth >= m * radius + j)
                if not len(active):
                    return best_q, best_c, best_d
                if m * math.comb(hi - lo, radius) > n:
                    q, c = np.nonzero(~seen[active])
                    add(active[q], c)
                    return best_q, best_c, best_d
                masks = np.array([sum(1 << b for b in chosen) for chosen in combinations(range(hi - lo), radius)], np.int64)
                if not len(masks):
                    continue
                probes = values[j][active][:, None] ^ masks[None, :]
                first, count = self.begin[j][probes].ravel(), (self.begin[j][probes + 1] - self.begin[j][probes]).ravel()
                if not (total := int(count.sum())):
                    continue
                inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                c = self.order[j][np.repeat(first, count) + inside]
                q = np.repeat(np.repeat(active, len(masks)), count)
                new = ~seen[q, c]
                q, c = q[new], c[new]
                seen[q, c] = True
                add(q, c)
        return best_q, best_c, best_d


def _words(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)


def top_k(rows: DataFrame, queries: Column, k: int = K, row_id: str = "vec_id", embedding: str = "embedding", block_codes: int = BLOCK_CODES, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """vec_id, rank, neighbor_id and distance of the k nearest rows of each row for which `queries` (of __id) holds."""
    session(rows.sparkSession)
    coded = cut(codes(rows, row_id, embedding).distinct())
    nth = F.row_number().over(Window.partitionBy("__code").orderBy("__id"))
    entries = coded.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("__code").agg(F.sort_array(F.collect_list("__id")).alias("ids"))
    entries = cut(entries)
    asked = coded.where(queries)
    asked_codes = asked.select("__code").distinct()
    size, width, n_asked = (*entries.agg(F.count("*"), F.max(F.octet_length("__code"))).first(), asked_codes.count())
    blocks, asked_blocks, width = max(1, -(-size // block_codes)), max(1, -(-n_asked // block_queries)), (width or 8) // 8

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked_codes.select("__code", F.pmod(F.xxhash64(F.lit(1), "__code"), F.lit(asked_blocks)).cast("int").alias("qb"), every(blocks).alias("b"))
    right = entries.select("__code", F.col("ids")[0].alias("least"), F.pmod(F.xxhash64(F.lit(2), "__code"), F.lit(blocks)).cast("int").alias("b"), every(asked_blocks).alias("qb"))

    def search(key, q: pa.Table, c: pa.Table) -> pa.Table:
        q_codes, c_codes, out = q.column("__code"), c.column("__code"), ([], [], [], [])
        if q.num_rows and c.num_rows:
            index, words, names = Index(_words(c_codes, width)), _words(q_codes, width), c.column("least").to_numpy()
            for at in range(0, len(words), 256):
                a, b, d = index.search(words[at : at + 256], names, k + 1)
                for column, values in zip(out, (q_codes.take(pa.array(a + at)).to_pylist(), c_codes.take(pa.array(b)).to_pylist(), names[b].tolist(), d.tolist()), strict=True):
                    column += values
        return pa.table([pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["__asked", "__code", "least", "distance"])

    found = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(search, "__asked binary, __code binary, least long, distance long")
    # The k + 1 nearest entries hold the k + 1 nearest rows.
    nearest = found.withColumn("r", F.row_number().over(Window.partitionBy("__asked").orderBy("distance", "least"))).where(F.col("r") <= k + 1)
    named = nearest.join(entries, "__code").select("__asked", "distance", F.explode("ids").alias("neighbor_id"))
    named = named.withColumn("r", F.row_number().over(Window.partitionBy("__asked").orderBy("distance", "neighbor_id"))).where(F.col("r") <= k + 1)
    best = named.groupBy("__asked").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    each = asked.join(best, F.col("__code") == F.col("__asked"))
    others = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("__id")), 1, k)
    return each.select(F.col("__id").alias(row_id), F.posexplode(others).alias("p", "x")).select(row_id, (F.col("p") + 1).alias("rank"), "x.neighbor_id", "x.distance")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("__id"), F.lit(QUERY_STEP)) == 0)


SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS (SELECT q.vec_id, e.vec_id AS neighbor_id, len(list_filter(list_zip(q.b, e.b), lambda z: z[1] <> z[2]))::BIGINT AS distance FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM p)
SELECT vec_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
