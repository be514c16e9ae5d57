"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of WINDOW consecutive words (a shorter item is one window). A window is a set of
word shingles, and a document contains it only if it contains all of them; so of a window's shingles, ordered by
rarity, the prefix of one (the rarest) is necessary. Rarity is counted over all documents. Documents join windows on
that shingle; the length bound (the document has at least as many words) and the positional bound (the window fits
around the shingle's place) come before the exact comparison of the words.

Words and shingles are compared by 64-bit hashes first, and every occurrence by the words themselves. An index is arrays
of numbers and the items' folded text: up to ten times the items' bytes. One index of MAX_INDEX_BYTES of benchmark goes to
every task; a larger benchmark is dealt into blocks below that size, which are joined one after the other, with the hits of
each block kept beside the documents. Documents are looked at PART bytes at a time.

Edge cases: null or wordless texts have no words and no hits; items without words have no windows; a null item_id
counts as the empty string; rows of the same item_id are one item; repeated documents come out as often as they
come in; an empty table of documents gives no rows, and without items nothing is hit. Other columns of either table are
never looked at, and those of the documents are kept, but for __n_words, __spans and __items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import PART, RUN, RUN_TOO, Words, arrow_map, cut, mix, pieces, schema_with, session, table, text_batches

WINDOW = 10
SHINGLE = 3
#: Bytes of benchmark text in one index: it takes up to ten times as many.
MAX_INDEX_BYTES = 8 << 20
#: What lies between words becomes a blank, A-Z become a-z.
_FOLD = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Keys:
    """Sorted hashes, with a bitmap that rules out most others."""

    BITS = 20

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are among the keys, and which key each is."""
        at = np.flatnonzero(valid & self.seen[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[k] == hashes[at]
        return at[hit], k[hit]


def _frequencies(docs: DataFrame, text: str, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By width: how often each of the benchmark's shingles (sorted hashes) stands in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(shingles)

    def make():
        keys = {width: Keys(own) for width, own in known.value.items()}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for _, texts in text_batches(batch.column(0)):
                for width, own in keys.items():
                    for words, _ in _parts(texts, width):
                        k, n = np.unique(own.places(*words.runs(width))[1], return_counts=True)
                        out.append((np.full(len(k), width), k, n))
            columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in zip(*out, strict=True)] or [np.empty(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["width", "k", "n"])

        return step

    counted = arrow_map(docs.select(F.col(text).alias("t")), make, "width long, k long, n long").groupBy("width", "k").agg(F.sum("n").alias("n"))
    out = {width: np.zeros(len(own), np.int64) for width, own in shingles.items()}
    for r in counted.toLocalIterator():
        out[r["width"]][r["k"]] = r["n"]
    return out


def _parts(texts: list[bytes], overlap: int) -> Iterator[tuple[Words, int]]:
    """Words of the texts; a long text in parts, each with the overlap - 1 words before it, whose number is given."""
    if len(texts) > 1 or len(texts[0]) <= PART:
        yield Words(texts, _FOLD), 0
        return
    carry, n = b"", 0
    for part in pieces(texts[0], _GAP, PART):
        words = Words([carry + part], _FOLD)
        yield words, n
        n = min(overlap - 1, len(words))
        carry = words.data[words.starts[len(words) - n] :] + b" " if n else b""


class Index:
    """The windows of items, each under the rarest of its shingles: as arrays, about 50 bytes a word of the items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, width: int, rarity) -> None:
        """rarity: of sorted shingle hashes by width, how often each stands in the documents."""
        self.window, self.names = window, [name for name, _ in items]
        self.words = words = Words([data for _, data in items], _FOLD)
        counts = np.diff(words.first)
        # Of each item: where its windows begin, and how many words they have.
        each = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
        item = np.repeat(np.arange(len(items)), each)
        start = words.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
        size = np.minimum(counts[item], window)
        one, two = np.zeros(len(item), np.uint64), np.zeros(len(item), np.uint64)
        for n in np.unique(size).tolist():
            own = size == n
            one[own], two[own] = words.runs(n)[0][start[own]], words.runs(n, RUN_TOO)[0][start[own]]
        # Equal windows are one, of several items.
        order = np.lexsort((item, two, one, size))
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (size, one, two)], axis=0) if len(order) > 1 else new[1:]
        lead = order[new]
        group = np.cumsum(new) - 1
        pairs = np.unique(np.stack([group, item[order]], axis=1), axis=0) if len(order) else np.empty((0, 2), np.int64)
        self.owner_of, self.owners = np.searchsorted(pairs[:, 0], np.arange(len(lead) + 1)), pairs[:, 1].astype(np.int32)
        self.start, self.size, self.hash = start[lead].astype(np.int32), size[lead].astype(np.int16), one[lead]
        # The prefix: the rarest shingle.
        wide = np.minimum(self.size, width)
        runs = {int(w): words.runs(int(w))[0] for w in np.unique(wide)}
        inside = {}
        for w, own in runs.items():
            may = [(wide == w) & (self.size - w >= k) for k in range(window - w + 1)]
            inside[w] = np.unique(np.concatenate([own[self.start[m] + k] for k, m in enumerate(may)]))
        often = rarity(inside)
        self.place, key = np.zeros(len(lead), np.int16), np.zeros(len(lead), np.uint64)
        least = np.full(len(lead), np.iinfo(np.int64).max)
        for w, own in inside.items():
            for k in range(window - w + 1):
                may = np.flatnonzero((wide == w) & (self.size - w >= k))
                hashes = runs[w][self.start[may] + k]
                n = often[w][np.searchsorted(own, hashes)]
                better = n < least[may]
                least[may[better]], self.place[may[better]], key[may[better]] = n[better], k, hashes[better]
        # By width: the prefix shingles, and which windows each has.
        self.under = {}
        for w in runs:
            own = np.flatnonzero(wide == w)
            own = own[np.argsort(key[own], kind="stable")]
            keys, first = np.unique(key[own], return_index=True)
            self.under[w] = (Keys(keys), np.append(first, len(own)), own)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of all occurrences."""
        found = []
        for width, (keys, first, windows) in self.under.items():
            at, k = keys.places(*words.runs(width))
            n = first[k + 1] - first[k]
            at, window = np.repeat(at, n), windows[np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            start, size, text = at - self.place[window], self.size[window], words.text[at]
            # Length and position: the window fits into the text around the shingle's place.
            fits = (start >= words.first[text]) & (start + size <= words.first[text + 1])
            start, window, size = start[fits], window[fits], size[fits]
            for n in np.unique(size).tolist():
                own = np.flatnonzero(size == n)
                total = np.zeros(len(own), np.uint64)
                for j in range(n):
                    total += words.hashes[start[own] + j] * RUN[j]
                own = own[mix(total) == self.hash[window[own]]]
                same = [words.said(s, n) == self.words.said(self.start[w], n) for s, w in zip(start[own].tolist(), window[own].tolist(), strict=True)]
                own = own[np.array(same, bool)]
                found.append((start[own], window[own]))
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*found, strict=True)) or [(), ()]))

    def find(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of each text: number of words, merged hit spans (in words, end exclusive) and items."""
        counts, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        for words, carried in _parts(texts, self.window):
            # The words before a part of a long text were counted with the part before.
            before = [counts[0] - carried] if carried else counts[:]
            start, window = self.hits(words)
            for s, w in zip(start.tolist(), window.tolist(), strict=True):
                t = int(words.text[s])
                at = s - int(words.first[t]) + before[t]
                spans[t].append((at, at + int(self.size[w])))
                items[t].update(self.names[i] for i in self.owners[self.owner_of[w] : self.owner_of[w + 1]].tolist())
            counts = [a + n for a, n in zip(before, np.diff(words.first).tolist(), strict=True)]
        return [(n, merged(s), i) for n, s, i in zip(counts, spans, items, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, width: int = SHINGLE, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """docs with __n_words, __spans (hit words, merged) and __items (ids of items that have occurring windows)."""
    spark = session(docs.sparkSession)
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // max_index_bytes) or 1
    docs = docs.drop("__n_words", "__spans", "__items")
    names = docs.columns
    out = docs.withColumns({"__n_words": F.lit(0).cast("long"), "__spans": F.array().cast("array<struct<start:long,end:long>>"), "__items": F.array().cast("array<string>")})
    schema = schema_with(docs, names, "__n_words long, __spans array<struct<start:long,end:long>>, __items array<string>")
    for block in range(blocks):
        items = [(r["i"], r["t"].encode()) for r in bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().toLocalIterator()]
        shared = spark.sparkContext.broadcast(Index(items, window, width, lambda shingles: _frequencies(docs, text, shingles)))

        def make(shared=shared):
            index = shared.value

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                columns = [batch.column(k) for k in range(len(names))]
                found = [x for _, texts in text_batches(columns[names.index(text)]) for x in index.find(texts)]
                before = zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names) + 2).to_pylist(), strict=True)
                counts, spans, hits = [], [], []
                for (n, more, fresh), (old_spans, old_items) in zip(found, before, strict=True):
                    counts.append(n)
                    spans.append([{"start": a, "end": b} for a, b in merged([*((s["start"], s["end"]) for s in old_spans), *more])])
                    hits.append(sorted(fresh | set(old_items)))
                return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(hits, pa.list_(pa.string()))], names=[*names, "__n_words", "__spans", "__items"])

            return step

        out = arrow_map(out, make, schema)
        if block + 1 < blocks:
            out = cut(out)
    return out


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: The same by windows of words that are joined as lists.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT i, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
h AS (SELECT p.r, p.k, v.n, v.i FROM p CROSS JOIN (SELECT DISTINCT n FROM v) z JOIN v ON v.n = z.n AND v.g = array_to_string(p.w[p.k:p.k + z.n - 1], ' ') WHERE p.k + z.n - 1 <= len(p.w)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT r, k, n FROM h)) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT r, i FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r)
"""
