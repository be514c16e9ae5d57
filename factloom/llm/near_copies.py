"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly.

This is the SimHash operator's form for that rule. Its fingerprints are those of five-word shingles, and its trie self-join
proposes the first pairs: equal fingerprints and those that differ in two bits or fewer. But two sets of that similarity
differ in 10 of 64 bits on average, in up to 17, and a trie can't prune before the budget is spent. So what the trie
leaves out is found by a prefix filter, in three more rounds; all pairs, from wherever, are verified by the sets themselves.

Of two sets that are so similar, the first 0.2 * n + 1 shingles in any order that holds for all sets have one in
common. The order puts shingles that stand in many documents last (counted in one of SAMPLE sets), the others by their
hash. Each set is dealt out under its first shingles; sets that meet under one are candidates if their sizes and the
shingle's places still allow the similarity, and the parities of their hashes, of which each row carries a sketch, don't
rule it out. Candidates that more parities leave are compared by their whole sets. No link is left to chance;
only the 64-bit hashes stand for the shingles and for equal sets.

A large group is not compared pair by pair: in the prefix filter's rounds but the last, a set under a shingle is a candidate
with the likeliest leader it may be similar to, and a leader itself if there is none; and each round leaves out all pairs that
links connect already. The last round takes all pairs that are left.

Edge cases: columns of any names and types are carried through; an empty table gives no rows; of texts with fewer than five words all words are the one shingle; null and wordless texts have the empty
set and are copies of one another. Ids and repeated rows are treated as in simhash_dedup.keep_one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import PART, Words, arrow_map, cut, freed, join_hot, made_here, pieces, removed, schema_with, session, text_batches, written
from factloom.llm import simhash_dedup
from factloom.llm.simhash_dedup import _SPACE, SEED, components, keep_least

SHINGLE_WORDS = 5
#: White space becomes a blank, A-Z become a-z.
_FOLD = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Least similarity, in tenths.
TENTHS = 8
#: One of so many sets is counted to find the common shingles, and how often a common one stands in those at least.
SAMPLE = 16
COMMON = 8
#: The common shingles that go to every task, the most common first; the others keep their place by hash.
MOST_COMMON = 200_000
#: Bits by which most candidates are ruled out before their texts are read, of sets of fewer than LARGE shingles and of others.
PARITIES, LARGE, MORE_PARITIES = 1024, 1500, 16384
#: Rounds of the prefix filter in which a set is a candidate with one other under each shingle, before the one with all.
LEADER_ROUNDS = 2
#: A side of a join with no more rows than this may go to every task.
SMALL_ROWS = 100_000


def shingle_sets(texts: list[bytes], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Of each text: the sorted distinct hashes of its shingles."""
    if len(texts) == 1 and len(texts[0]) > PART:
        found, carry = [], b""
        for part in pieces(texts[0], _SPACE, PART):
            words = Words([carry + part], _FOLD)
            found.append(np.unique(words.runs(width)[0]))
            n = min(width - 1, len(words))
            carry = words.data[words.starts[len(words) - n] :] + b" " if n else b""
        own = np.unique(np.concatenate(found))
        return [own if len(own) else shingle_sets([carry], width)[0]]
    words = Words(texts, _FOLD)
    runs, whole = words.runs(width)
    of, runs = words.text[: len(runs)][whole], runs[whole]
    order = np.lexsort((runs, of))
    of, runs = of[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    of, runs = of[new], runs[new]
    out = np.split(runs, np.searchsorted(of, np.arange(1, len(texts))))
    counts = np.diff(words.first)
    for k in np.flatnonzero((counts > 0) & (counts < width)).tolist():
        n = int(counts[k])
        out[k] = words.runs(n)[0][words.first[k] : words.first[k] + 1]
    return out


def label(own: np.ndarray) -> int:
    """A signed long that equal sets share; 0 for the empty one."""
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0], np.uint64).view(np.int64)[0])


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set as a signed long: 1 where over half of its hashes have a 1."""
    ones = np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own)).view(">u8").astype(np.uint64).view(np.int64)[0])


def _mapped(source: DataFrame, keep: list[str], values, ddl: str) -> DataFrame:
    """The kept columns and what values() says of each row's set; the text is the last column of source."""
    n = len(keep)

    def make():
        step_of = values()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [step_of(own) for _, texts in text_batches(batch.column(n)) for own in shingle_sets(texts)]
            kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
            fields = [f.split(" ") for f in ddl.split(", ")]
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), *(pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields))], names=[*keep, *(name for name, _ in fields)])

        return step

    return arrow_map(source, make, schema_with(source, keep, ddl))


def _signed(own: np.ndarray) -> list[int]:
    return own.view(np.int64).tolist()


def labels(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns and __fp, the label of the set."""
    return _mapped(docs.select(*keep, F.col(text)), keep, lambda: lambda own: (label(own),), "__fp long")


def _labels_and_sample(docs: DataFrame) -> DataFrame:
    def values():
        def of(own: np.ndarray):
            name = label(own)
            return name, fingerprint(own), _signed(own) if name % SAMPLE == 0 else None

        return of

    return _mapped(docs.select("__id", "__text"), ["__id"], values, "__fp long, print long, own array<long>")


def first_shingles(own: np.ndarray, late: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Those of a set that one of every similar set is among. late: sorted common shingles; ranks: their order."""
    take = len(own) - -(-TENTHS * len(own) // 10) + 1
    if not len(late) or not len(own):
        return own[:take]
    at = np.minimum(np.searchsorted(late, own), len(late) - 1)
    rank = np.where(late[at] == own, ranks[at], 0)
    return own[np.lexsort((own, rank))[:take]]


def parities(own: np.ndarray) -> np.ndarray:
    """In how many of a set's hashes, odd or even, each remainder is, as bits. Where two sets' bits differ, the sets do."""
    width = PARITIES if len(own) < LARGE else MORE_PARITIES
    odd = np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def sketch(bits: np.ndarray) -> bytes:
    """A set's parities by PARITIES remainders, of those by any multiple of them."""
    return np.bitwise_xor.reduce(bits.reshape(-1, PARITIES // 64), axis=0).tobytes()


def _sets(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(__fp, size, first, bits, sketch) of every distinct set that isn't empty."""
    sampled = prints.where(F.col("own").isNotNull()).dropDuplicates(["__fp"])
    often = sampled.select(F.explode("own").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    rows = [(r["token"], r["n"]) for r in often.orderBy(F.desc("n"), "token").limit(MOST_COMMON).collect()]
    late, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(late)
    shared = docs.sparkSession.sparkContext.broadcast((late[order], n[order]))

    def values():
        known = shared.value

        def of(own: np.ndarray):
            bits = parities(own)
            return label(own), len(own), _signed(first_shingles(own, *known)), _signed(bits), sketch(bits)

        return of

    sets = _mapped(docs.select("__text"), [], values, "__fp long, size int, first array<long>, bits array<long>, sketch binary").where("size > 0")
    return written(sets.dropDuplicates(["__fp"]), "sets")


def _not_alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token: those whose token another row has, too."""
    held, before = None, None  # the last row, and the token of the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch])
        token = rows.column(0).to_numpy()
        same = np.concatenate(([before is not None and before == token[0]], token[1:] == token[:-1]))
        shared = same | np.concatenate((same[1:], [False]))
        yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(shared[:-1])).combine_chunks().to_batches()
        held, before = rows.slice(rows.num_rows - 1).combine_chunks().to_batches()[0], token[-1] if same[-1] else None
    if held is not None and before is not None:
        yield held


def _dealt(sets: DataFrame) -> DataFrame:
    """(token, size, __fp, at): every set under its first shingles, without those that no other set has among its first."""
    rows = sets.select("__fp", "size", F.posexplode("first").alias("at", "token")).select("token", "size", "__fp", "at")
    rows = rows.repartition("token").sortWithinPartitions("token")
    return written(rows.mapInArrow(_not_alone, "token long, size int, __fp long, at int"), "dealt")


def _may(size_a: int, at_a: int, size_b: int, at_b: int) -> bool:
    """Whether sets with a common shingle at these places can be similar."""
    most = min(at_a, at_b) + 1 + min(size_a - at_a, size_b - at_b) - 1
    return (10 + TENTHS) * most >= TENTHS * (size_a + size_b)


def _candidates(batches: Iterable[pa.RecordBatch], star: bool) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and size: pairs of labels that may be similar; star: of each with the likeliest leader only."""
    key, near, least, found = None, {}, 0, set()  # near: by root, those of similar size, by size; if star, the leaders

    def out() -> pa.RecordBatch:
        pairs = np.array(list(found), np.int64).reshape(-1, 2)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for token, size, name, at, root, drawn in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if token != key:
                key, near, least = token, {}, size
            if near and 10 * least < TENTHS * size:
                near = {r: own for r, others in near.items() if (own := [x for x in others if 10 * x[0] >= TENTHS * size])}
                least = min((own[0][0] for own in near.values()), default=size)
            bits, best = int.from_bytes(drawn, "little"), None
            for other_root, others in near.items():
                if other_root == root:
                    continue
                for other in others:
                    both, differ = other[0] + size, (other[3] ^ bits).bit_count()
                    # |A| + |B| - 2 |A and B| is at least `differ`.
                    if (10 + TENTHS) * (both - differ) >= 2 * TENTHS * both and _may(other[0], other[2], size, at):
                        if not star:
                            found.add((min(other[1], name), max(other[1], name)))
                        elif best is None or differ * best[1] < best[0] * both:
                            best = differ, both, other[1]
            if best:
                found.add((min(best[2], name), max(best[2], name)))
            else:
                near.setdefault(root, []).append((size, name, at, bits))
            if len(found) > 50_000:
                yield out()
    if found:
        yield out()


def _met(dealt: DataFrame, star: bool) -> DataFrame:
    rows = dealt.select("token", "size", "__fp", "at", "root", "sketch").repartition("token").sortWithinPartitions("token", "size", "__fp")
    return rows.mapInArrow(lambda batches: _candidates(batches, star), "a long, b long").distinct()


def _similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose sets have the similarity."""
    side = lambda k: sets.select(F.col("__fp").alias(k), F.col("size").alias(f"size_{k}"), F.col("bits").alias(f"bits_{k}"))
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    # |A| + |B| - 2 |A and B| is at least `differ`.
    likely = (10 + TENTHS) * (F.col("size_a") + F.col("size_b") - differ) >= 2 * TENTHS * (F.col("size_a") + F.col("size_b"))
    likely = (F.size("bits_a") != F.size("bits_b")) | likely
    pairs = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(likely).select("a", "b"))
    needed = cut(pairs.select(F.col("a").alias("__fp")).union(pairs.select("b")).distinct().join(classes, "__fp"))
    few = needed.count() <= SMALL_ROWS
    ids = needed.select(F.col("least").alias("__least")).distinct()
    ids, own = (F.broadcast(ids), F.broadcast(needed.select("__fp"))) if few else (ids, needed.select("__fp"))
    some = docs.join(ids, docs["__id"].eqNullSafe(ids["__least"]), "left_semi").select("__text")
    some = _mapped(some, [], lambda: lambda own: (label(own), own.tobytes()), "__fp long, own binary")
    with made_here() as own_files:
        whole = written(some.join(own, "__fp", "left_semi").dropDuplicates(["__fp"]), "whole")
    body = lambda k: whole.select(F.col("__fp").alias(k), F.col("own").alias(f"own_{k}"))
    both = pairs.join(body("a"), "a").join(body("b"), "b").select("a", "b", "own_a", "own_b")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append((10 + TENTHS) * shared >= TENTHS * (len(one) + len(two)))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    found = cut(arrow_map(both, make, "a long, b long"))
    removed(docs.sparkSession, own_files)
    freed(docs.sparkSession)
    return found


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of labels whose SimHash fingerprints are equal or link, by one label for each fingerprint."""
    own = cut(prints.select("__fp", "print").where("__fp <> 0").distinct())
    first = cut(own.groupBy("print").agg(F.min("__fp").alias("least"), F.count("*").alias("__n")))
    same = join_hot(own, first, "print").where("__fp > least").select(F.col("least").alias("a"), F.col("__fp").alias("b"))
    found = simhash_dedup.links(first.select(F.col("print").alias("__fp")))
    name = lambda k: first.select(F.col("print").alias(k), F.col("least").alias(f"least_{k}"))
    near = found.join(name("a"), "a").join(name("b"), "b")
    return same.unionByName(near.select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b")))


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of labels of similar sets, enough to connect all that are similar. docs: __id, __text."""
    classes = cut(prints.groupBy("__fp").agg(F.min("__id").alias("least")))
    with made_here() as own_files:
        sets = _sets(docs, prints)
    freed(docs.sparkSession)
    found = _similar(_by_fingerprint(prints), docs, classes, sets)
    with made_here() as more_files:
        dealt = _dealt(sets)
    own_files += more_files
    freed(docs.sparkSession)
    for star in [True] * LEADER_ROUNDS + [False]:
        roots = components(found)
        named = sets.select("__fp", "sketch").join(roots, sets["__fp"] == roots["node"], "left")
        rooted = dealt.join(named.select("__fp", "sketch", F.coalesce("root", "__fp").alias("root")), "__fp")
        found = cut(found.unionByName(_similar(_met(rooted, star), docs, classes, sets)).distinct())
    removed(docs.sparkSession, own_files)
    return found


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near copies: of each group that links connect, the row with the least doc_id (of repeated rows, one)."""
    session(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    prints = cut(_labels_and_sample(named))
    return keep_least(docs, doc_id, text, prints.select("__id", "__fp"), lambda _: links(named, prints), labels)
