"""Best-fit packing of token sequences by bin completion.

Pieces of at most CAPACITY tokens are counted by length: CAPACITY numbers, however large the corpus. The search
works on these counts. Its incumbent is what best fit makes of the lengths in falling order, its bound the least number
of bins that any packing needs (tokens, and pieces that can't share a bin). Bin completion then takes the longest piece
left again and again and enumerates the undominated fillings of the rest of its bin, the least waste first; a branch ends
where the waste so far proves that it can't beat the incumbent. Branches are taken in the order of their discrepancies:
first always the best filling, then one step with another filling, then two, and so on. The search ends when the
incumbent meets the bound, or after SEARCH_NODES steps; plan() returns the bound with the plan, so what may be left is
known. A filling is used as often as the counts allow, which uses up at least one length; so there are at most CAPACITY
fillings, and the plan (runs of equal pieces) is small enough to go to every task.

A filling is dominated if one of its pieces, or two of them together, could be replaced by a single longer piece that is
left, with less waste: whatever is packed with it can then be packed as well with the other.

Which piece gets which place follows from its rank among the pieces of its length: the place of its partition, plus
its place within it. Ranks need no window over a common length; only counts by partition and length are shuffled.

Edge cases: a null or empty text is its end token alone; an empty table gives no rows; repeated rows are packed each
for itself; null ids stay. Long texts are encoded whole. Columns of the input that aren't kept are never looked at; kept ones
may not be named piece, start, length, ids_crc32, ids, sequence_id or offset.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import LONG_TEXT, arrow_map, cut, schema_with, session, table, written

CAPACITY = 1024
END = 2
#: Steps of the search for a plan, and of that for the fillings of one bin; the incumbent stands if none is better within them.
SEARCH_NODES, FILLING_NODES = 300_000, 4000
#: Fillings of one bin that the search may choose among.
CHOICES = 6
#: Words whose ids a task keeps; beyond it, words are encoded each time they come.
KEPT_WORDS = 400_000
#: So many rows of three numbers may go to every task.
SMALL_ROWS = 1_000_000


def _numbers(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """ids of a text as a byte-level BPE tokenizer file gives them, as little-endian unsigned 32-bit numbers.

    Words between single blanks are encoded by themselves (the tokenizer never joins across them) and kept.
    Texts in which white space meets white space, and those with special tokens, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on.
        plain = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        bytes_of = {c: b for b, c in plain.items()}
        bytes_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
        self.words = _Words(self.encoding)

    def whole(self, text: str) -> bytes:
        return _numbers(self.encoding.encode(text, allowed_special="all"))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        out, at = [], 0
        while at < len(text):
            cut = len(text) if len(text) - at <= LONG_TEXT else _boundary(text, at + LONG_TEXT)
            part, at = text[at:cut], cut
            words = part.split(" ")
            head, tail = words[0], words[1:]
            if not head and out:
                words, head = tail, None  # the blank belongs to the first word
            try:
                if head is not None and (head[:1].isspace() or head[-1:].isspace() or not head and tail):
                    raise KeyError(head)
                out += [b"" if head is None else self.whole(head), b"".join(map(self.words.__getitem__, tail))]
            except KeyError:
                out.append(self.whole(part))
        return b"".join(out)


def _boundary(text: str, at: int) -> int:
    """The next place of a blank between two characters that aren't white space, or the end."""
    while (at := text.find(" ", at)) > 0:
        if at + 1 < len(text) and not text[at - 1].isspace() and not text[at + 1].isspace():
            return at
        at += 1
    return len(text)


class _Words(dict):
    def __init__(self, encoding) -> None:
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        ids = _numbers(self.encode(" " + word))
        if len(self) < KEPT_WORDS:
            self[word] = ids
        return ids


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; of several, the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


Filling = tuple[int, ...]  # longest piece first
Packing = list[tuple[Filling, int]]  # fillings, and how many bins have each


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each length a, pieces above capacity - a are alone, those above half never share."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in sizes.tolist()], np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    for a in [0, *sizes[2 * sizes <= capacity].tolist()]:
        alone, half, small = sizes > capacity - a, (2 * sizes > capacity) & (sizes <= capacity - a), (sizes >= a) & (2 * sizes <= capacity)
        spare = int((n * (capacity - sizes))[half].sum())
        best = max(best, int(n[alone].sum() + n[half].sum()) + max(0, -(-(int((sizes * n)[small].sum()) - spare) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best fit of the lengths in falling order; equal bins are kept as one."""
    bins: dict[int, list[list]] = defaultdict(list)  # free place -> [filling, how many]
    free: list[int] = []  # sorted

    def put(space: int, filling: Filling, n: int) -> None:
        if not bins[space]:
            insort(free, space)
        bins[space].append([filling, n])

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(free, size)
            if k == len(free):
                each = min(capacity // size, left)
                put(capacity - each * size, (size,) * each, left // each)
                left -= left // each * each
                continue
            space = free[k]
            filling, n = bins[space].pop()
            if not bins[space]:
                free.pop(k)
            each = min(space // size, left)
            used = min(n, left // each)
            if n > used:
                put(space, filling, n - used)
            put(space - each * size, filling + (size,) * each, used)
            left -= used * each
    return [(tuple(f), n) for found in bins.values() for f, n in found]


def fillings(rest: int, left: list[int], counts: dict[int, int], most: int = CHOICES, nodes: int = FILLING_NODES) -> tuple[list[Filling], int]:
    """Undominated fillings of `rest` from the ascending lengths `left`, least waste first (`most` of them, the first by best fit or better), and the steps taken."""
    found: list[tuple[int, Filling]] = []
    total = [0]
    for size in left:
        total.append(total[-1] + size * counts[size])
    budget = nodes

    def could(size: int, used: Filling) -> bool:
        return used.count(size) < counts[size]

    def dominated(filling: Filling, free: int) -> bool:
        parts = {*filling, *(filling[x] + filling[y] for x in range(len(filling)) for y in range(x))} if len(filling) < 12 else set(filling)
        for part in parts:
            k = bisect_right(left, part + free)
            if k and left[k - 1] > part and could(left[k - 1], filling):
                return True
        return False

    def grow(top: int, free: int, filling: Filling) -> bool:
        """Tries lengths below place `top`, longest first; True when nothing can be better."""
        nonlocal budget
        top = min(top, bisect_right(left, free))
        k, open_end = top, True
        while k:
            k -= 1
            budget -= 1
            worst = found[-1][0] if len(found) == most else free + 1
            # Even all that is left below can't fill enough to beat what is known.
            if budget < 0 or free - total[k + 1] >= worst:
                return budget < 0
            if could(left[k], filling):
                open_end = False
                if grow(k + 1, free - left[k], filling + (left[k],)):
                    return True
                if len(found) == most and found[-1][0] == 0:
                    return True
        if open_end and not any(f == filling for _, f in found) and not dominated(filling, free):
            insort(found, (free, filling), key=lambda x: x[0])
            del found[most:]
        return False

    # Best fit: the longest that fits, again and again.
    first, free, k = (), rest, len(left)
    while free and (k := min(k, bisect_right(left, free))):
        if could(left[k - 1], first):
            first += (left[k - 1],)
            free -= left[k - 1]
        else:
            k -= 1
    found.append((free, first))
    if free or most > 1:
        grow(len(left), rest, ())
    return [f for _, f in found], nodes - max(budget, 0)


def completed(counts: dict[int, int], capacity: int, allowed: int, skips: int, budget: list[int]) -> Packing | None:
    """A packing that wastes at most `allowed`, with at most `skips` steps that don't take the first filling; None if none is found."""
    trail: list[tuple[list[Filling], int, Filling, int, int, int]] = []
    counts, waste, out = dict(counts), 0, []
    options: list[Filling] | None = None
    nth = 0
    while True:
        left = sorted(s for s, n in counts.items() if n)
        if not left:
            return out
        top = left[-1]
        if options is None:
            counts[top] -= 1
            options, steps = fillings(capacity - top, left, counts, CHOICES if skips else 1)
            counts[top] += 1
            nth, budget[0] = 0, budget[0] - 20 - steps
        ok = False
        if nth < len(options) and (nth == 0 or skips) and budget[0] > 0:
            filling = (top, *options[nth])
            need = Counter(filling)
            times = min(counts[s] // n for s, n in need.items())
            more = waste + times * (capacity - sum(filling))
            ok = more <= allowed
        if ok:
            trail.append((options, nth, filling, times, waste, skips))
            for s, n in need.items():
                counts[s] -= n * times
            waste, skips = more, skips - (nth > 0)
            out.append((filling, times))
            options = None
            continue
        # Nothing (more) here: back to the last step that has another choice.
        while True:
            if not trail or budget[0] <= 0:
                return None
            options, nth, filling, times, waste, skips = trail.pop()
            out.pop()
            for s, n in Counter(filling).items():
                counts[s] += n * times
            nth += 1
            if nth < len(options) and skips:
                break


def packing_of(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> tuple[Packing, int]:
    """The best packing found, and the lower bound."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return [], 0
    bound, tokens = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    size = lambda packing: sum(n for _, n in packing)
    budget, skips = [nodes], 0
    while size(best) > bound and budget[0] > 0 and skips <= len(counts):
        better = completed(counts, capacity, (size(best) - 1) * capacity - tokens, skips, budget)
        if better is None:
            skips += 1
        else:
            best = better
    return best, bound


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Runs (length, first rank, last rank + 1, first bin, pieces of this run in a bin, offset), the number of bins and its lower bound."""
    packing, bound = packing_of(counts, capacity, nodes)
    used, runs, bins = Counter(), [], 0
    for filling, times in packing:
        offset = 0
        for size, n in sorted(Counter(filling).items(), reverse=True):
            runs.append((size, used[size], used[size] + n * times, bins, n, offset))
            used[size] += n * times
            offset += n * size
        bins += times
    return runs, bins, bound


def tokenized(docs: DataFrame, keep: list[str], path: str, text: str = "text", end: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: the kept columns, piece, start, length, ids_crc32 (and ids), and its place in its task."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    stop = _numbers([end])

    def make():
        encoder, seen, task = Encoder(path), Counter(), TaskContext.get().partitionId()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple[int, int, int, int, int, int]] = []
            ids_of: list[bytes] = []
            for k, text in enumerate(batch.column(len(keep)).to_pylist()):
                ids = encoder(text or "") + stop
                for piece, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((k, piece, start, length, crc32(own), seen[length]))
                    seen[length] += 1
                    if with_ids:
                        ids_of.append(own)
            at = np.array(rows, np.int64).reshape(-1, 6)
            kept = [batch.column(k).take(pa.array(at[:, 0])) for k in range(len(keep))]
            numbers = [pa.array(at[:, 1].astype(np.int32)), *(pa.array(at[:, k]) for k in (2, 3, 4, 5)), pa.array(np.full(len(at), task, np.int64))]
            ids_column = [pa.array(ids_of, pa.binary())] if with_ids else []
            return pa.RecordBatch.from_arrays([*kept, *numbers, *ids_column], names=[*keep, "piece", "start", "length", "ids_crc32", "__nth", "__task", *["ids"] * with_ids])

        return step

    return arrow_map(source, make, schema_with(source, keep, "piece int, start long, length long, ids_crc32 long, __nth long, __task long" + ", ids binary" * with_ids))


def pack(docs: DataFrame, keep: list[str], path: str, text: str = "text", end: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """tokenized() with sequence_id and offset of each piece. ids (little-endian 32-bit) on demand."""
    spark = session(docs.sparkSession)
    rows = written(tokenized(docs, keep, path, text, end, capacity, with_ids), "pieces")
    by_task = rows.groupBy("__task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _, _ = plan(counts, capacity)
    before = by_task.select("__task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("__task")) - F.col("n")).alias("__before"))
    # Pieces stay where they are unless there are very many tasks.
    before = cut(before)
    ranked = rows.join(F.broadcast(before) if before.count() <= SMALL_ROWS else before, ["__task", "length"])
    by_length: dict[int, list] = defaultdict(list)
    for run in runs:
        by_length[run[0]].append(run)
    starts = {size: np.array([r[1] for r in found]) for size, found in by_length.items()}
    shared = spark.sparkContext.broadcast(({s: np.array(f, np.int64) for s, f in by_length.items()}, starts))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        table_of, starts_of = shared.value
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for size in np.unique(sizes):
            own = sizes == size
            run = table_of[size][np.searchsorted(starts_of[size], ranks[own], "right") - 1]
            nth = ranks[own] - run[:, 1]
            bins[own] = run[:, 3] + nth // run[:, 4]
            offsets[own] = run[:, 5] + nth % run[:, 4] * size
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    placed = ranked.withColumn("__at", place("length", F.col("__before") + F.col("__nth")))
    more = ["ids"] * with_ids
    return placed.select(*keep, "piece", "start", "length", "ids_crc32", "__at.sequence_id", "__at.offset", *more)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], tokenizer_path())
