"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is what its tokens say: the words with A-Z in lower case, each with the blank that ends it, and one end (the byte
0xFF, which UTF-8 never has, as a word of its own); so the model and the unigram base give probabilities of the same
thing. Each byte is eight binary decisions, highest bit first. The predictors count zeros and ones behind

* the last 2 (with their place in the word), 3 and 4 bytes of the word (with its beginning), hashed,
* the whole word so far, and
* the whole word so far with the text's class.

A text's class is one of CLASSES, by a hash of the word of up to 3 bytes that it has most often: a sign of its language.
It is said before the text and costs log2(CLASSES) bits.

The predictors' log odds are added with weights; the set of weights is chosen (gated) by how much the predictors have seen
and by the bit's place. The mixture's probability is refined by an adaptive map from (bits so far, quantised log odds) to
the frequency really seen. The bits' costs add up to the text's total, a proper probability over all texts.

But for the class, contexts end at the word's beginning. So what a word costs is worked out once for each distinct pair of
class and word in the corpus and joined to the documents, which is what makes tables that grow with the corpus affordable.
(With a class of the word before instead, counting the pairs alone took four times as long; the README has the figures.)

Learning, all of it over all training documents:
1. tasks count the pairs, of all documents, with how often training has them; the counts are summed in Spark;
2. the counts behind the last 2 to 4 bytes, and behind fewer than SPLIT bytes of a word with the class, are summed by
   context, and go into hashed tables of fixed width (contexts as short as these are soon all known), which go to every task;
3. the pairs are dealt out by their first SPLIT bytes. All words that a longer beginning has are then in one group, which
   counts them exactly: these tables grow with the corpus, and nobody holds them whole. Groups learn the weights online,
   block by block in the order of a hash, each context as often as it was seen and with its own occurrence left out of the
   counts it is predicted from, and the refining map on the way. The groups' weights and maps are averaged;
4. the groups work out what their pairs cost.
What belongs to a group follows from the data alone, not from how Spark deals out tasks, and is put together in the groups'
order: the same documents always give the same scores.

A unigram base goes with it, by counts of words that are summed in the same groups. The most frequent pairs, at most HEAVY, go to
every task; the others are joined.

Edge cases: null texts are empty; an empty text has its end only; without training documents every bit costs one bit
and every token's base term is 0; an empty table gives no rows. Repeated rows and null ids stay and are scored each for
itself. A word of any length is read whole. Columns other than the kept ones and the text are never looked at; kept ones may
not have the names of those that this adds, or begin with `__`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import LONG_TEXT, arrow_map, binary_list, mix, pieces, remainder, schema_with, session, table, trimmed, written

#: Bytes behind which the hashed tables count, and log2 of the slots of each; then that of class and word beginning.
SHORT, BITS = (2, 3, 4), (20, 21, 22, 21)
CLASSES = 16
#: Words are dealt out by so many first bytes; beyond LIMIT bytes the whole word so far is no context any more.
SPLIT, LIMIT = 4, 24
PREDICTORS = len(SHORT) + 2
#: Distinct pairs of one group, about.
GROUP_ROWS = 200_000
PAGE = 1 << 16
RATE, BLOCK = 0.15, 4096
#: Blocks that a group learns from at least: a small group's blocks are smaller, and come again if they would be too small.
LEAST_BLOCKS, SMALL_BLOCK = 400, 256
#: Numbers that a task gathers before it sums them up, and bytes that it looks at together.
GATHERED, LOOKED_AT = 1_000_000, 1 << 16
#: Bytes of pairs and their counts, each run's for itself, that a task gathers before it sums them up.
COUNTED = 48 << 20
STEPS = 33
#: The most frequent pairs, at most so many, go to every task.
HEAVY = 200_000
#: Parts of one in which log10 counts (coarse, then what these leave over, fine) and bits are added up.
COARSE, FINE, BIT_PARTS = 1 << 20, 1 << 48, 1 << 24
END, GAP = b"\xff", 0x20
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
_U = np.uint64


def words_of(text: bytes | None) -> Counter[bytes]:
    """How often a text has each word; the end is one of them."""
    out: Counter[bytes] = Counter()
    for part in pieces(text or b"", _SPACE):
        out.update(part.lower().split())
    out[END] = 1
    return out


def class_of(short: Counter[bytes]) -> bytes:
    """The byte of a text's class; short: how often the text has each word of up to 3 bytes."""
    sign = max(((n, word) for word, n in short.items()), default=(0, b""))[1]
    return bytes((zlib.crc32(sign) % CLASSES,))


def kind_of(words: Counter[bytes]) -> bytes:
    """The byte of the class of a text that has these words."""
    return class_of({word: n for word, n in words.items() if len(word) < 4 and word != END})


def pairs_of(text: bytes | None) -> dict[bytes, int]:
    """How often a text has each word, with the byte of the text's class before it."""
    words = words_of(text)
    kind = kind_of(words)
    return {kind + word: n for word, n in words.items()}


class Tokens:
    """The words of texts and the texts' ends, one after another in one run of bytes, each behind the byte of its text's class."""

    def __init__(self, texts: list[bytes], kind: int | None = None, end: bool = True) -> None:
        """kind: the class of all texts, if it is known; end: whether the texts end here."""
        tail = b" " + END if end else b""
        data = (b" " + (tail + b" ").join(texts) + tail + b" ").translate(_FOLD)
        codes = np.frombuffer(data, np.uint8)
        blank = codes == GAP
        gaps = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before each word
        first = np.searchsorted(gaps, np.cumsum([0, *(len(t) + len(tail) + 1 for t in texts[:-1])]))
        #: Of each text, how many words it has; of each word, its text.
        self.words = np.diff(np.append(first, len(gaps)))
        self.text = np.repeat(np.arange(len(texts)), self.words)
        more = blank[:-1] & blank[1:]
        self.codes = codes[:-1][~more]
        self.starts = gaps - np.searchsorted(np.flatnonzero(more), gaps)
        #: Bytes of each word with its class's.
        self.lengths = np.diff(np.append(self.starts, len(self.codes)))
        if kind is None:
            short = self.lengths < 5
            if end:
                short[first[1:] - 1] = short[-1:] = False
            signs, times = self._signs(np.flatnonzero(short))
            best, texts_of = np.zeros(len(texts), _U), (signs >> _U(32)).astype(np.int64)
            edges = np.flatnonzero(np.diff(texts_of, prepend=-1))
            if len(edges):
                best[texts_of[edges]] = np.maximum.reduceat(times.astype(_U) << _U(32) | signs & _U(0xFFFFFFFF), edges)
            sign, place = np.unique(best & _U(0xFFFFFFFF), return_inverse=True)
            self.kinds = np.array([kind_of_sign(x) for x in sign.tolist()], np.uint8)[place]
        else:
            self.kinds = np.full(len(texts), kind, np.uint8)
        self.codes[self.starts] = self.kinds[self.text]

    def _signs(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words `own`, of up to 3 bytes: each text with each word, as one number in the words' order, and how often it has it."""
        at, length, value = self.starts[own], self.lengths[own] - 1, self.text[own].astype(_U) << _U(32)
        for k in range(3):
            value |= np.where(length > k, self.codes.take(at + k + 1, mode="clip"), 0).astype(_U) << _U(24 - 8 * k)
        return np.unique(value | length.astype(_U), return_counts=True)

    def pairs(self) -> pa.Array:
        """Each word behind the byte of its text's class."""
        offsets = np.append(self.starts, len(self.codes)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.codes)])

    def signs(self) -> dict[int, int]:
        """How often one text, which doesn't end here, has each word of up to 3 bytes, as a number."""
        return dict(zip(*(x.tolist() for x in self._signs(np.flatnonzero(self.lengths < 5))), strict=True))


_FOLD = bytes(GAP if c in b" \t\n\v\f\r" else c + 32 if c in range(65, 91) else c for c in range(256))


def kind_of_sign(sign: int) -> int:
    """The class by a word of up to 3 bytes, given as those bytes and then their number."""
    data = sign.to_bytes(4, "big")
    return zlib.crc32(data[: data[3]]) % CLASSES


def tokens_of(texts: list[bytes | None]) -> Iterator[tuple[int, Tokens]]:
    """Number of the first text, and the tokens of texts of up to LONG_TEXT bytes together; a longer text comes piece by piece."""
    held, total, first = [], 0, 0
    for k, data in enumerate(texts):
        data = data or b""
        if held and total + len(data) > LONG_TEXT:
            yield first, Tokens(held)
            held, total = [], 0
        if len(data) > LONG_TEXT:
            short: Counter[int] = Counter()
            for part in pieces(data, _SPACE):
                short.update(Tokens([part], 0, end=False).signs())
            kind = kind_of_sign(max(((n, sign) for sign, n in short.items()), default=(0, 0))[1])
            for part in pieces(data, _SPACE):
                yield k, Tokens([part], kind, end=False)
            yield k, Tokens([b""], kind)
            continue
        if not held:
            first = k
        held.append(data)
        total += len(data)
    if held:
        yield first, Tokens(held)


class Pairs:
    """How often the texts added have each pair, and how often those that are learned from: counted run by run, and summed at the end."""

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.waiting: list[tuple[bytes | None, bool]] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size = self.new = 0

    def add(self, text: bytes | None, own: bool = True) -> None:
        self.waiting.append((text, own))
        self.new += len(text or b"") + 3
        if self.new > LONG_TEXT:
            self._look()

    def _look(self) -> None:
        owns = np.array([own for _, own in self.waiting], bool)
        for first, tokens in tokens_of([text for text, _ in self.waiting]):
            found = tokens.pairs().dictionary_encode()
            place, keys = found.indices.to_numpy(), found.dictionary
            n = np.bincount(place[owns[first + tokens.text]], minlength=len(keys))
            self.parts.append((keys, n, np.bincount(place, minlength=len(keys))))
            self.size += keys.nbytes + 16 * len(keys)
        self.waiting, self.new = [], 0

    def counts(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pairs, and how often texts that are learned from and all texts have each."""
        self._look()
        found = pa.concat_arrays([pa.array([], pa.binary()), *(keys for keys, _, _ in self.parts)]).dictionary_encode()
        place, keys = found.indices.to_numpy(), found.dictionary
        n, m = (np.bincount(place, np.concatenate([np.empty(0), *(part[k] for part in self.parts)]), len(keys)).astype(np.int64) for k in (1, 2))
        return keys, n, m

    @property
    def held(self) -> int:
        return len(self.counts()[0])

    def taken(self) -> dict[bytes, int]:
        keys, _, m = self.counts()
        self._clear()
        return dict(zip(keys.to_pylist(), m.tolist(), strict=True))

    def batch(self) -> pa.RecordBatch:
        keys, n, m = self.counts()
        self._clear()
        return pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(m)], names=["key", "n", "m"])


def count_pairs(texts: DataFrame) -> DataFrame:
    """(key, n, m) of (text, learned from): how often training and all texts have each pair."""

    def run(batches):
        pairs = Pairs()
        for batch in batches:
            for data, own in zip(binary_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                pairs.add(data, own)
                if pairs.size > COUNTED:
                    yield pairs.batch()
        yield pairs.batch()
        trimmed()

    return texts.mapInArrow(run, "key binary, n long, m long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Spelled:
    """Keys as one run of bytes: each word and the blank behind it."""

    def __init__(self, keys: pa.Array) -> None:
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        data = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        self.starts, self.lengths = offsets[:-1] - offsets[0], np.diff(offsets)
        self.kinds = data[self.starts].astype(_U)
        # A key's first byte is its class; in its place stands the blank behind the word before.
        self.bytes = np.append(data[1:], np.uint8(GAP))
        self.bytes[self.starts[1:] - 1] = GAP

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Word, place in it, and the 4 bytes before (the word's beginning counts as a blank, before it are zeros)."""
        word = np.searchsorted(self.starts, at, "right") - 1
        place = at - self.starts[word]
        back = []
        for k in range(1, max(SHORT) + 1):
            byte = self.bytes[np.maximum(at - k, 0)].astype(_U)
            back.append(np.where(place >= k, byte, np.where(place == k - 1, _U(GAP), _U(0))))
        return word, place, back

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The 4 bytes before; the last 2 of them with the place in the word; all of them with the class (NONE further on in a word)."""
        word, place, back = self.around(at)
        four = back[0] | back[1] << _U(8) | back[2] << _U(16) | back[3] << _U(24)
        placed = (four & _U(0xFFFF)) | np.minimum(place, LIMIT).astype(_U) << _U(16)
        return four, placed, np.where(place < SPLIT, four | self.kinds[word] << _U(32), NONE)


NONE = _U(1 << 48)


def _contexts(four: np.ndarray | None, placed: np.ndarray | None, begun: np.ndarray | None) -> list[np.ndarray | None]:
    """A hash for each of the hashed tables."""
    of = lambda key, salt: None if key is None else mix(key + _U(salt << 58))
    return [of(placed, 2), None if four is None else of(four & _U(0xFFFFFF), 3), of(four, 4), of(begun, 5)]


_STARTS = np.cumsum([0, *(1 << b for b in BITS)])
SLOTS = int(_STARTS[-1])
_SHIFTS = np.array([[64 - b] for b in BITS], _U)


def _slots(contexts: list[np.ndarray | None], byte: np.ndarray, bit: int) -> list[np.ndarray | None]:
    """For each hashed table: the slot of the bit's context."""
    so_far = (_U(1 << bit) | (byte.astype(_U) >> _U(8 - bit))) * _U(0xD6E8FEB86659FD93)
    return [None if c is None else (mix(c + so_far) >> _U(64 - b)).astype(np.int64) + s for c, b, s in zip(contexts, BITS, _STARTS, strict=False)]


def _all_slots(contexts: np.ndarray, byte: np.ndarray, bit: int) -> np.ndarray:
    """As _slots(), of the contexts of all tables in one array."""
    so_far = (_U(1 << bit) | (byte.astype(_U) >> _U(8 - bit))) * _U(0xD6E8FEB86659FD93)
    return (mix(contexts + so_far) >> _SHIFTS).astype(np.int64) + _STARTS[:-1, None]


def _short_counts(counted: DataFrame) -> DataFrame:
    """(kind, key, n): how often a byte stands behind 4 bytes (0), behind 2 bytes at a place (1), and behind a class and a word's beginning (2)."""

    def run(batches):
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]

        def merge() -> None:
            for kind, own in enumerate(held):
                if len(own) > 1:
                    keys, place = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                    held[kind] = [(keys, np.bincount(place, np.concatenate([n for _, n in own])))]

        def out(kind: int) -> pa.RecordBatch:
            keys, n = held[kind].pop()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

        for batch in batches:
            spelled, times = Spelled(batch.column(0)), batch.column(1).to_numpy().astype(np.float64)
            for first in range(0, len(spelled.bytes), LOOKED_AT):
                at = np.arange(first, min(first + LOOKED_AT, len(spelled.bytes)))
                n = times[np.searchsorted(spelled.starts, at, "right") - 1]
                for kind, key in enumerate(spelled.keys(at)):
                    has = key != NONE
                    keys, place = np.unique((key << _U(8) | spelled.bytes[at].astype(_U))[has], return_inverse=True)
                    held[kind].append((keys, np.bincount(place, n[has], len(keys))))
            if sum(len(k) for own in held for k, _ in own) > 2 * GATHERED:
                merge()
                for kind, own in enumerate(held):
                    if len(own[0][0]) > GATHERED:
                        yield out(kind)
        merge()
        for kind, own in enumerate(held):
            if own:
                yield out(kind)
        trimmed()

    parts = counted.where("n > 0").select("key", "n").mapInArrow(run, "kind int, key long, n long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _hashed_counts(counted: DataFrame) -> dict[int, bytes]:
    """Pages of the hashed tables' counts, compressed."""

    def slots(batches):
        held, size = [], 0

        def out():
            at, zeros, ones = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            distinct, place = np.unique(at, return_inverse=True)
            counts = np.stack([np.bincount(place, zeros), np.bincount(place, ones)]).astype("<u8")
            edges = np.flatnonzero(np.diff(distinct // PAGE, prepend=-1))
            pages = []
            for lo, hi in zip(edges, [*edges[1:], len(distinct)], strict=True):
                pages.append(zlib.compress((distinct[lo:hi] % PAGE).astype("<u2").tobytes() + counts[:, lo:hi].tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(distinct[edges] // PAGE), pa.array(pages, pa.binary())], names=["page", "part"])

        for batch in batches:
            kinds, keys, times = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(_U), batch.column(2).to_numpy().astype(np.float64)
            for kind in range(3):
                own = kinds == kind
                key, n = keys[own], times[own]
                byte = (key & _U(0xFF)).astype(np.int64)
                contexts = _contexts(*(key >> _U(8) if k == kind else None for k in range(3)))
                for bit in range(8):
                    one = (byte >> (7 - bit)) & 1
                    for slot in _slots(contexts, byte, bit):
                        if slot is not None:
                            held.append((slot, n * (1 - one), n * one))
                            size += len(slot)
            if size > 2 * GATHERED:
                yield out()
                size = 0
        if size:
            yield out()
        trimmed()

    def page(group: pa.Table) -> pa.Table:
        n = np.zeros((2, PAGE))
        for part in group.column("part").to_pylist():
            data = zlib.decompress(part)
            size = len(data) // 18
            n[:, np.frombuffer(data, "<u2", size)] += np.frombuffer(data, "<u8", 2 * size, 2 * size).reshape(2, size)
        # Half precision is exact for what is rare; of larger counts the ratio is kept.
        n *= np.minimum(1, 60_000 / np.maximum(n.max(axis=0), 1))
        return pa.table([pa.array([group.column("page")[0].as_py()], pa.int64()), pa.array([zlib.compress(n.astype(np.float16).tobytes(), 1)], pa.binary())], names=["page", "counts"])

    parts = _short_counts(counted).mapInArrow(slots, "page long, part binary")
    return {r["page"]: bytes(r["counts"]) for r in parts.groupBy("page").applyInArrow(page, "page long, counts binary").toLocalIterator()}


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log odds of a one, of counts."""
    return np.log((n1 + np.float32(0.05)) / (n0 + np.float32(0.05)))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _bucket(n: np.ndarray) -> np.ndarray:
    """0, 1, 2-3, 4-15, 16 and more."""
    return (n > 0.5).astype(np.int64) + (n > 1.5) + (n > 3.5) + (n > 15.5)


GATES = 5 * 5 * 2 * 8


def _cell(z: np.ndarray, byte: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower of the two cells of the refining map that log odds lie between, and how far up from it."""
    at = (np.clip(z, -7.999, 7.999) + 8) * ((STEPS - 1) / 16)
    low = at.astype(np.int64)
    return ((1 << bit) | (byte.astype(np.int64) >> (8 - bit))) * STEPS + low, at - low


class Edges:
    """The distinct steps from a pair's word's beginning to its next byte, of one group of pairs."""

    def __init__(self, keys: pa.Array, times: np.ndarray) -> None:
        self.spelled = spelled = Spelled(keys)
        n_bytes = len(spelled.bytes)
        self.of = np.zeros(n_bytes, np.int64)  # of each byte, its edge
        words = np.arange(len(spelled.starts))
        node = {"word": np.zeros(len(words), np.int64), "pair": spelled.kinds.astype(np.int64)}
        at, byte, weight, counts, size = [], [], [], {"word": [], "pair": []}, 0
        for level in range(LIMIT):
            words = words[spelled.lengths[words] > level]
            if not len(words):
                break
            here = spelled.starts[words] + level
            n, step, found = times[words], spelled.bytes[here].astype(np.int64), {}
            for kind in ("word", "pair"):
                edge, first, place = np.unique(node[kind][words] << 8 | step, return_index=True, return_inverse=True)
                found[kind] = (edge, first, place, np.bincount(place, n))
                node[kind][words] = place
            edge, first, place, total = found["pair"]
            self.of[here] = size + place
            size += len(edge)
            at.append(here[first])
            byte.append(step[first])
            weight.append(total)
            for kind, pick in (("word", found["word"][2][first]), ("pair", slice(None))):
                split = self._splits(found[kind][0], found[kind][3]) if level >= SPLIT else np.zeros((len(found[kind][0]), 16), np.float32)
                counts[kind].append(split[pick])
        # What lies further on in a word is a step of its own.
        lengths = spelled.lengths
        far = np.flatnonzero(np.arange(n_bytes) - np.repeat(spelled.starts, lengths) >= LIMIT)
        self.of[far] = size + np.arange(len(far))
        at.append(far)
        byte.append(spelled.bytes[far].astype(np.int64))
        weight.append(np.repeat(times, lengths)[far])
        self.at, self.byte, self.weight = (np.concatenate(x) for x in (at, byte, weight))
        self.counts = {kind: np.concatenate([*own, np.zeros((len(far), 16), np.float32)]).T for kind, own in counts.items()}  # an edge's lie side by side

    @staticmethod
    def _splits(edges: np.ndarray, total: np.ndarray) -> np.ndarray:
        """For sorted edges (node, byte) and their counts: zeros and ones at each bit on the way to the byte."""
        sums = np.concatenate(([0.0], np.cumsum(total)))
        out = np.empty((len(edges), 16), np.float32)
        low, value = np.searchsorted(edges, edges & ~0xFF), edges & ~0xFF
        high = np.searchsorted(edges, (edges | 0xFF) + 1)
        for bit in range(8):
            middle = value + (128 >> bit)
            mid = np.searchsorted(edges, middle)
            out[:, 2 * bit], out[:, 2 * bit + 1] = sums[mid] - sums[low], sums[high] - sums[mid]
            one = (edges >> (7 - bit)) & 1 > 0
            low, high, value = np.where(one, mid, low), np.where(one, high, mid), np.where(one, middle, value)
        return out


class Mixer:
    """The hashed tables, the weights and the refining map."""

    def __init__(self, hashed: np.ndarray, weights: np.ndarray | None = None, refine: np.ndarray | None = None) -> None:
        # Zeros and ones of a slot as one number of 8 bytes.
        self.hashed, self.refine = np.ascontiguousarray(hashed.T, np.float32).view(_U).ravel(), refine
        self.weights = np.full((GATES, PREDICTORS + 1), 0.25) if weights is None else weights.copy()
        self.slopes = np.full((GATES, PREDICTORS + 1), 1e-4)

    def inputs(self, edges: Edges, own: np.ndarray, leave_out: bool):
        """For each bit of the bytes of the edges `own`: the bit, the log odds of each predictor (and a constant), and the gate."""
        byte, keys = edges.byte[own], edges.spelled.keys(edges.at[own])
        # The first bytes of a word are all that 4 bytes can hold.
        begun, contexts = keys[2] != NONE, np.stack(_contexts(*keys))
        word, pair = (np.ascontiguousarray(edges.counts[kind].T[own].T) for kind in ("word", "pair"))
        n = np.empty((PREDICTORS, 2, len(own)), np.float32)
        x = np.full((PREDICTORS + 1, len(own)), 0.3, np.float32)
        for bit in range(8):
            one = ((byte >> (7 - bit)) & 1).astype(np.float32)
            hashed = self.hashed.take(_all_slots(contexts, byte, bit)).view(np.float32).reshape(len(BITS), -1, 2).transpose(0, 2, 1)
            n[:3] = hashed[:3]
            for k, table, counts in ((3, 2, word), (4, 3, pair)):
                n[k] = np.where(begun, hashed[table], counts[2 * bit : 2 * bit + 2])
            if leave_out:
                n[:, 0] -= 1 - one
                n[:, 1] -= one
                np.maximum(n, 0, out=n)
            x[:PREDICTORS] = _stretch(n[:, 0], n[:, 1])
            seen = _bucket(n[3:, 0] + n[3:, 1])
            gate = ((seen[0] * 5 + seen[1]) * 2 + (n[2, 0] + n[2, 1] > 3.5)) * 8 + bit
            yield one, x, gate

    def odds(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ji->i", self.weights.take(gate, axis=0), x)

    def learn(self, edges: Edges, own: np.ndarray, cells: np.ndarray) -> None:
        """One online step a bit, over a block of edges; a weight's steps get smaller as its gradients add up.

        cells: weighted numbers of bits and of ones for each cell of the refining map, to which the block is added.
        """
        times, byte = edges.weight[own], edges.byte[own]
        for bit, (one, x, gate) in enumerate(self.inputs(edges, own, True)):
            z = self.odds(x, gate)
            low, part = _cell(z, byte, bit)
            at, share = np.concatenate((low, low + 1)), np.concatenate(((1 - part) * times, part * times))
            cells[0] += np.bincount(at, share, cells.shape[1])
            cells[1] += np.bincount(at, share * np.tile(one, 2), cells.shape[1])
            miss = (one - _squash(z)) * times
            total = np.maximum(np.bincount(gate, times, GATES), 1e-9)
            each = (gate + GATES * np.arange(PREDICTORS + 1)[:, None]).ravel()
            slope = np.bincount(each, (miss * x).ravel(), len(x) * GATES).reshape(len(x), GATES).T / total[:, None]
            self.slopes += slope * slope
            self.weights += RATE * slope / np.sqrt(self.slopes)
            np.clip(self.weights, -4, 4, out=self.weights)

    def costs(self, edges: Edges, own: np.ndarray) -> np.ndarray:
        """Bits that each edge's byte costs."""
        out, byte = np.zeros(len(own)), edges.byte[own]
        for bit, (one, x, gate) in enumerate(self.inputs(edges, own, False)):
            z = self.odds(x, gate)
            p = _squash(z)
            if self.refine is not None:
                low, part = _cell(z, byte, bit)
                p = (p + self.refine[low] * (1 - part) + self.refine[low + 1] * part) / 2
            out -= np.log2(np.clip(np.where(one > 0, p, 1 - p), 1e-6, 1 - 1e-6))
        return out


def _blocks(n: int, size: int, order: np.ndarray | None = None):
    for first in range(0, n, size):
        yield order[first : first + size] if order is not None else np.arange(first, min(first + size, n))


def hashed_of(model: dict) -> np.ndarray:
    """The hashed tables' zeros and ones, unpacked once in a worker; those of a slot lie side by side."""
    if "hashed" not in model:
        n = np.zeros((-(-SLOTS // PAGE) * PAGE, 2), np.float32)
        for page, data in model["pages"].items():
            n[page * PAGE : (page + 1) * PAGE] = np.frombuffer(zlib.decompress(data), np.float16).reshape(2, PAGE).T
        model["hashed"] = n.T
    return model["hashed"]


def _sorted(group: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys, n and m in the order of the keys."""
    group = group.sort_by("key")
    return group.column("key").combine_chunks(), group.column("n").to_numpy().astype(np.float64), group.column("m").to_numpy()


def word_costs(texts: DataFrame) -> DataFrame:
    """(key, bits, coarse, fine, known, n, m, lead) of the pairs of (text, learned from): what each costs, the log10 of half more than training has
    the word, whether it has it, how often it has the pair, and all texts the pair; lead: 1 for one pair of each word of training. Costs and
    logarithms are whole numbers of small parts, which add up to the same sums in any order and fit a long for texts of 2 GB."""
    spark = session(texts.sparkSession)
    counted = written(count_pairs(texts), "pairs")
    rows, learned = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, -(-rows // GROUP_ROWS))
    begin = F.expr(f"substring(key, 2, {SPLIT})")
    grouped = counted.withColumn("g", F.pmod(F.xxhash64(begin), F.lit(groups)).cast("int"))
    shared = spark.sparkContext.broadcast({"pages": _hashed_counts(counted) if learned else {}})
    weights, cells = np.zeros((GATES, PREDICTORS + 1)), np.tile(_squash(np.arange(STEPS) * (16 / (STEPS - 1)) - 8), 256)
    if learned:

        def learn(group: pa.Table) -> pa.Table:
            trimmed()
            keys, n, _ = _sorted(group)
            edges, mixer = Edges(keys, n), Mixer(hashed_of(shared.value))
            own = np.flatnonzero(edges.weight > 0)
            own = own[np.argsort(mix(own.astype(_U) + _U(3)), kind="stable")]
            size, rounds = max(SMALL_BLOCK, min(BLOCK, len(own) // LEAST_BLOCKS)), -(-LEAST_BLOCKS * SMALL_BLOCK // max(len(own), LEAST_BLOCKS))
            blocks, cells = [block for _ in range(rounds) for block in _blocks(len(own), size, own)], None
            for k, block in enumerate(blocks):
                if k in (0, len(blocks) // 2):
                    cells = np.zeros((2, 256 * STEPS))  # the map is that of the second half, by weights that have settled
                mixer.learn(edges, block, cells)
            row = [group.column("g")[:1].to_pylist(), [float(edges.weight.sum())], [mixer.weights.ravel().tolist()], [cells.ravel().tolist()]]
            return pa.table([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.list_(pa.float64())), pa.array(row[3], pa.list_(pa.float64()))], names=["g", "n", "w", "c"])

        # Sums by number, so that the driver gets one row for each; floats are added in the groups' order.
        parts = written(grouped.where("n > 0").groupBy("g").applyInArrow(learn, "g int, n double, w array<double>, c array<double>"), "weights")
        in_order = lambda value: F.aggregate(F.array_sort(F.collect_list(F.struct("g", value.alias("x")))), F.lit(0.0), lambda a, s: a + s["x"])
        total = parts.agg(in_order(F.col("n"))).first()[0]
        flat = parts.select("g", "n", F.posexplode("w").alias("k", "w")).groupBy("k").agg(in_order(F.col("n") * F.col("w")).alias("w"))
        for r in flat.toLocalIterator():
            weights.flat[r["k"]] = r["w"] / total
        both = np.zeros(2 * 256 * STEPS)
        for r in parts.select("g", F.posexplode("c").alias("k", "c")).where("c <> 0").groupBy("k").agg(in_order(F.col("c")).alias("c")).toLocalIterator():
            both[r["k"]] = r["c"]
        seen, ones = both.reshape(2, -1)
        cells = (ones + 20 * cells) / (seen + 20)
    mixed = spark.sparkContext.broadcast((weights, cells if learned else None))

    def cost(group: pa.Table) -> pa.Table:
        trimmed()
        keys, n, m = _sorted(group)
        edges, mixer = Edges(keys, n), Mixer(hashed_of(shared.value), *mixed.value)
        each = np.concatenate([mixer.costs(edges, block) for block in _blocks(len(edges.at), LOOKED_AT)])
        bits = np.add.reduceat(each[edges.of], edges.spelled.starts)
        total: Counter[bytes] = Counter()
        words = [key[1:] for key in keys.to_pylist()]
        for word, times in zip(words, n.tolist(), strict=True):
            total[word] += int(times)
        left, lead = {word for word, times in total.items() if times}, []
        for word in words:
            lead.append(int(word in left))
            left.discard(word)
        often = np.array([total[w] for w in words], np.int64)
        log = np.log10(often + 0.5)
        coarse = np.floor(log * COARSE)
        columns = [np.round(bits * BIT_PARTS), coarse, np.round((log - coarse / COARSE) * FINE), often > 0, n]
        return pa.table([keys, *(pa.array(c.astype(np.int64)) for c in columns), pa.array(m), pa.array(lead, pa.int32())], names=["key", *SUMMED, "n", "m", "lead"])

    return written(grouped.groupBy("g").applyInArrow(cost, f"key binary, {', '.join(f'{c} long' for c in SUMMED)}, n long, m long, lead int"), "costs")


#: What a text's tokens add up.
SUMMED = ("bits", "coarse", "fine", "known")


def _least(costs: DataFrame, every: int) -> int:
    """How often texts have each of the most frequent pairs at least, so that these are HEAVY at most; every: how many tokens there are."""
    grade = F.floor(F.log2("m") * 16)
    most, least = 0, -(-every // HEAVY)  # so often or more: at most HEAVY pairs in any case
    for r in costs.groupBy(grade.alias("g")).agg(F.count("*").alias("n"), F.min("m").alias("m")).orderBy(F.desc("g")).collect():
        most += r["n"]
        if most > HEAVY:
            break
        least = min(least, r["m"])
    return max(2, least)


def score(docs: DataFrame, learned_from, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_tokens, n_known, train_tokens, base_score, score (both log10) and bits_per_byte (of the words and blanks).

    learned_from: a condition on docs; the model learns from the rows for which it holds.
    """
    spark = session(docs.sparkSession)
    costs = word_costs(docs.select(F.col(text).alias("t"), F.coalesce(learned_from, F.lit(False)).alias("own")))
    tokens, distinct, every = costs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("lead"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    least = _least(costs, every)
    heavy = costs.where(F.col("m") >= least).select("key", *SUMMED).toArrow()
    shared = spark.sparkContext.broadcast((heavy.column("key").combine_chunks().cast(pa.binary()), np.stack([heavy.column(c).to_numpy() for c in SUMMED])))
    scale = math.log10(tokens + 0.5 * (distinct + 1))
    source = docs.select(*keep, F.col(text).alias("__text"))
    sums = [f"__{c}" for c in SUMMED]

    def make():
        keys, values = shared.value
        number = TaskContext.get().partitionId() << 33

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            nonlocal number
            if not batch.num_rows:
                return None
            size, length = np.zeros((2, batch.num_rows), np.int64)
            added, rare = np.zeros((len(SUMMED), batch.num_rows), np.int64), []
            for first, tokens in tokens_of(binary_list(batch.column(len(keep)))):
                own = slice(first, first + len(tokens.words))
                size[own] += tokens.words
                np.add.at(length, first + tokens.text, tokens.lengths)  # a word and its blank: as many as with the class
                found = tokens.pairs().dictionary_encode()
                pairs = found.dictionary
                each, times = np.unique(tokens.text * len(pairs) + found.indices.to_numpy(), return_counts=True)
                row, pair = np.divmod(each, max(1, len(pairs)))
                at = pc.index_in(pairs, value_set=keys).fill_null(-1).to_numpy()[pair]
                here = at >= 0
                for total, value in zip(added, values, strict=True):
                    np.add.at(total, first + row[here], value[at[here]] * times[here])
                rare.append((first + row[~here], pairs.take(pa.array(pair[~here])), times[~here]))
            ends = np.cumsum(np.bincount(np.concatenate([r for r, _, _ in rare]), minlength=batch.num_rows))
            others = pa.StructArray.from_arrays([pa.concat_arrays([k for _, k, _ in rare]), pa.array(np.concatenate([n for _, _, n in rare]), pa.int64())], names=["key", "n"])
            columns = [np.arange(number, number + batch.num_rows), size, length, *added]
            number += batch.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), others)
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *(pa.array(c, pa.int64()) for c in columns), lists], names=[*keep, "__row", "n_tokens", "__bytes", *sums, "__rare"])

        return step

    scored = written(arrow_map(source, make, schema_with(source, keep, f"__row long, n_tokens long, __bytes long, {', '.join(f'{c} long' for c in sums)}, __rare array<struct<key:binary,n:long>>")), "scored")
    rare = scored.select("__row", F.explode("__rare").alias("r")).select("__row", "r.key", F.col("r.n").alias("times"))
    # Each pair has one row of costs, so a task's share of them is small: the documents' pairs needn't be sorted.
    found = rare.join(costs.where(F.col("m") < least).select("key", *SUMMED).hint("shuffle_hash"), "key")
    added = found.groupBy("__row").agg(*(F.sum(F.col("times") * F.col(c)).alias(f"{c}_more") for c in SUMMED))
    whole = scored.drop("__rare").join(added, "__row", "left")
    of = lambda c: F.col(f"__{c}") + F.coalesce(F.col(f"{c}_more"), F.lit(0))
    bits = of("bits") / F.lit(float(BIT_PARTS)) + F.lit(math.log2(CLASSES))
    base = of("coarse") / F.lit(float(COARSE)) + of("fine") / F.lit(float(FINE))
    return whole.select(
        *keep,
        "n_tokens",
        of("known").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (-bits * math.log10(2)).alias("score"),
        (bits / F.col("__bytes")).alias("bits_per_byte"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, remainder(F.col("doc_id"), 5) != 1, ["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
