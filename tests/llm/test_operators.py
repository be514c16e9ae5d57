"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import context_mixing, decontaminate, language_id, licenses, packing, personal_data, shard, simhash_dedup, topk_search, toxicity

N_ROWS = 10


# ---------------------------------------------------------------- 1


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=64).tolist()) for k in range(300)]
    rows += [(k, rows[7][1]) for k in range(300, 360)] + [(400, rows[7][1]), (400, rows[7][1]), (401, None), (None, rows[3][1]), (402, [None, float("nan")]), (403, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(frame, F.pmod(F.col("__id"), F.lit(20)) == 0, k=10, block_codes=100, block_queries=7).collect()
    codes = {i: [x is not None and x > 0 for x in v] + [False] * (64 - len(v)) for i, v in rows if i is not None and v}
    for q in (i for i in codes if i % 20 == 0):
        want = sorted((sum(a != b for a, b in zip(codes[q], c, strict=True)), i) for i, c in codes.items() if i != q)[:10]
        assert sorted((r["rank"], r["distance"], r["neighbor_id"]) for r in got if r["vec_id"] == q) == [(k, *w) for k, w in enumerate(want, 1)]
    assert topk_search.top_k(frame.where("false"), F.col("__id") == 0).count() == 0


# ---------------------------------------------------------------- 2


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g, d: max(map(int, g.split("."))) <= 255),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda g, d: 12 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda g, d: 9 <= len(d) <= 15),
    ]
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group())))


def test_base_spans_equal_brute_force(spark, nasty):
    rng = random.Random(3)
    bits = ["a.b@c.d", "x@y", "%", "@", ".", " ", "-", "+", "1.2.3.4", "300.1.2.3", "4539148803436467", "5555 5555", "+44 (0)20 7946 0018", "😀", "é", "7", "\n", "00", "q@r.s.t@u.v"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randrange(25)))) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["__spans"] or [] if s["kind"] != "id"] for r in personal_data.with_spans(frame).collect()}
    for k, text in rows:
        assert found[k] == [(s, e, kind) for s, _, e, kind in base(text)], text
    assert personal_data.with_spans(nasty).count() == N_ROWS


def test_bootstrap_finds_unseen_identifiers_and_masks(spark):
    rows = [(k, f"some words then account: user{k}@mail.example and more words") for k in range(20)]
    rows += [(100, "some words then account: ZX-99812-K and more"), (101, "see paragraph 99812345 of this, the year 20245"), (102, "also ZX-99812-K elsewhere")]
    rows += [(200 + k, "see paragraph about the thing") for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in personal_data.masked(frame).collect()}
    assert out[100] == "some words then account: [ID] and more" and out[102] == "also [ID] elsewhere"
    assert out[101] == rows[21][1] and out[3] == "some words then account: [EMAIL] and more words"


# ---------------------------------------------------------------- 3


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_fingerprints(monkeypatch):
    for text in ["", " ", "One", "One two", "a b c d e f g a b c", "x\x0by\x0cz  É é ß", "A" * 50 + " b c " * 30]:
        assert simhash_dedup.fingerprint(text.encode()) == slow_print(text)
    whole = "w%d " * 100 % tuple(range(100))
    expected = slow_print(whole)
    monkeypatch.setattr("factloom.llm.common.LONG_TEXT", 20)
    assert simhash_dedup.fingerprint(whole.encode()) == expected


def test_spark_hash_is_the_same(spark):
    words = ["", "abc", "é" * 40]
    got = [r["h"] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    assert got == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1).map(lambda x: x & 0xF00000000000000F | 0xABC0), max_size=60))
def test_trie_pairs(values):
    leaves = sorted(values)
    got = list(simhash_dedup.trie_pairs(leaves, None, 0, 64))
    want = {(a, b) for a, b in product(leaves, leaves) if a < b and (a ^ b).bit_count() <= 2}
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


@pytest.mark.parametrize("max_leaves", [200_000, 3])
def test_links_and_components(spark, max_leaves):
    rng = random.Random(9)
    prints = {0}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(8):
            prints.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.6:
                x ^= 1 << rng.randrange(64)
    signed = lambda x: x - (x >> 63 << 64)
    frame = spark.createDataFrame([(signed(x),) for x in prints], "__fp long")
    got = {(r["a"], r["b"]) for r in simhash_dedup.links(frame, max_leaves=max_leaves).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert got == want
    parent = {signed(x): signed(x) for x in prints}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in want:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    for one_task in (simhash_dedup.ONE_TASK, 0):  # in one task, and by rounds of joins
        rows = simhash_dedup.components(spark.createDataFrame(list(want), "a long, b long"), one_task).collect()
        assert len(rows) == len({n for pair in want for n in pair})
        assert {r["node"]: r["root"] for r in rows} == {n: find(n) for pair in want for n in pair}
    chain = spark.range(3000).selectExpr("3000 - id as a", "2999 - id as b")
    assert {(r["node"], r["root"]) for r in simhash_dedup.components(chain).collect()} == {(n, 0) for n in range(3001)}
    assert simhash_dedup.components(chain.where("false")).count() == 0


def test_near_duplicates_on_odd_rows(nasty, empty):
    rows = simhash_dedup.near_duplicates(nasty).collect()
    assert len(rows) == N_ROWS
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    kept = simhash_dedup.keep_one(nasty)
    assert kept.columns == nasty.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert simhash_dedup.keep_one(empty).count() == 0 == simhash_dedup.near_duplicates(empty).count()


# ---------------------------------------------------------------- 4, 8


def test_language_id(spark, nasty, empty):
    rng = random.Random(1)
    talk = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randrange(2, 8))) for _ in range(60))
    rows = [(k, talk("abcdefg") if k % 2 else talk("mnopqrñ"), "xx" if k % 2 else "yy") for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame.where("doc_id < 40"))
    said = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(frame, ["doc_id"], model).collect()}
    assert said == {k: lang for k, _, lang in rows}
    odd = language_id.predict(nasty, ["doc_id"], model).collect()
    assert len(odd) == N_ROWS and {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    none = language_id.train(empty)
    assert none.isEmpty() and {r["lang_pred"] for r in language_id.predict(nasty, ["doc_id"], none).collect()} == {"und"}
    assert language_id.predict(empty, ["doc_id"], model).count() == 0
    one_by_one = {r["doc_id"]: (r["lang_pred"], round(r["score"], 4)) for r in language_id.predict(frame, ["doc_id"], model, block=1).collect()}
    assert one_by_one == {r["doc_id"]: (r["lang_pred"], round(r["score"], 4)) for r in language_id.predict(frame, ["doc_id"], model).collect()}


def test_trigrams_equal_brute_force(monkeypatch):
    """Counts of a text in parts, and the cosine by vectors made one by one."""
    text = "Ab, cde  fé\U0001F600gh " * 9 + "x"
    clean = re.sub(r"[^\w]+", " ", f" {text.lower()} ")
    want = Counter(clean[k : k + 3] for k in range(len(clean) - 2))
    for part in (1 << 20, 7, 2):
        monkeypatch.setattr(language_id, "PART", part)
        keys, n = language_id.Profiles().counts(text)
        assert {"".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0)): c for k, c in zip(keys.tolist(), n.tolist(), strict=True)} == want
    profiles = language_id.Profiles(64)
    slow = sum(c * np.roll(profiles.letter(ord(g[0])), 2).astype(int) * np.roll(profiles.letter(ord(g[1])), 1) * profiles.letter(ord(g[2])) for g, c in want.items())
    assert np.allclose(profiles.bundle(*profiles.counts(text)), slow)


def test_toxicity(spark, nasty, empty):
    rng = random.Random(2)
    plain = ["stone", "river", "cloud", "table", "green", "walks", "often", "north"]
    rows, marks = [], []
    for k in range(300):
        words = rng.choices(plain, k=30)
        if bad := k % 5 == 0:
            words[rng.randrange(30)] = rng.choice(["grobnak", "zurgleth"])
        elif k % 19 == 0:
            words[3:5] = ["grobnak", "cider"]
        rows.append((k, " ".join(words)))
        marks.append((k, int(bad)))
    frame, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*marks, (None, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels.where("doc_id < 200 or doc_id is null"))
    assert "grobnak cider" in model["exceptions"]
    new = [(0, "river gr0bn4k north"), (1, "stone Zurgleth!"), (2, "green table cloud"), (3, "north grobnak cider"), (4, None), (5, "grоbnаk")]  # the last with homoglyphs
    assert toxicity.folded_words("$CUM!! gr0bn4k!!! a$$et @t it's 7@x") == ["scum", "grobnak", "asset", "at", "it", "s", "tax"]
    got = {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), ["doc_id"], model).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True}
    assert toxicity.score(nasty, ["doc_id"], model).count() == N_ROWS
    assert toxicity.fit(empty, labels)["weights"] == {}


# ---------------------------------------------------------------- 5


def test_lm_base_and_model(spark, nasty, empty):
    texts = ["the cat sat on the mat", "the dog sat on the log", "", None, "The  Cat\nsat", "a unique zebra " + "y" * 300] * 5
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = Counter(w for k, t in rows if k % 3 for w in [*(t or "").lower().split(), None])
    total = sum(counts.values())
    found = context_mixing.score(frame, F.col("doc_id") % 3 != 0, ["doc_id"]).collect()
    for r in found:
        words = [*(texts[r["doc_id"]] or "").lower().split(), None]
        want = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in words)
        assert abs(r["base_score"] - want) < 1e-9 and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r["score"] < 0
    # The same scores however Spark deals out the work, and whether pairs are joined or sent to every task.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    again = context_mixing.score(frame.repartition(7), F.col("doc_id") % 3 != 0, ["doc_id"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in found}
    unlearned = context_mixing.score(nasty, F.lit(False), ["doc_id"])
    assert unlearned.select(F.round(F.min("bits_per_byte"), 6)).first()[0] >= 8 and unlearned.where("abs(base_score) > 1e-6").count() == 0
    assert context_mixing.score(nasty, F.lit(True), ["doc_id"]).count() == N_ROWS and context_mixing.score(empty, F.lit(True), ["doc_id"]).count() == 0


def test_steps_equal_brute_force():
    """Contexts counted by arrays, and the pairs of a text."""
    kind = bytes((zlib.crc32(b"cat") % context_mixing.CLASSES,))
    assert context_mixing.pairs_of(b" There  cat\n cat THERE") == {kind + b"there": 2, kind + b"cat": 2, kind + b"\xff": 1}
    rng = random.Random(8)
    keys = sorted({bytes((rng.randrange(3),)) + "".join(rng.choices("abc", k=rng.randrange(1, 40))).encode() for _ in range(200)})
    times = np.array([float(rng.randrange(4)) for _ in keys])
    edges = context_mixing.Edges(pa.array(keys, pa.binary()), times)
    four, placed, begun = edges.spelled.keys(np.arange(len(edges.spelled.bytes)))
    at = 0
    for key in keys:
        word = key[1:] + b" "
        for j, byte in enumerate(word):
            edge = edges.of[at]
            before = (b"\0\0\0 " + word)[j : j + 4]
            assert edges.byte[edge] == byte and four[at] == int.from_bytes(before, "big") and placed[at] == int.from_bytes(before[2:], "big") + (min(j, context_mixing.LIMIT) << 16)
            assert begun[at] == (four[at] + (np.uint64(key[0]) << np.uint64(32)) if j < context_mixing.SPLIT else context_mixing.NONE)
            at += 1
            if j >= context_mixing.LIMIT or j < context_mixing.SPLIT:
                continue
            for name, start in (("pair", 0), ("word", 1)):
                same = [(k[1:] + b" ", n) for k, n in zip(keys, times, strict=True) if k[start : j + 1] == key[start : j + 1] and len(k) > j]
                for bit in range(8):
                    below = [(w, n) for w, n in same if w[j] >> (8 - bit) == byte >> (8 - bit)]
                    want = [sum(n for w, n in below if w[j] >> (7 - bit) & 1 == one) for one in (0, 1)]
                    assert edges.counts[name][2 * bit : 2 * bit + 2, edge].tolist() == want


def test_mixture_is_a_probability():
    """Over all bytes that can follow a beginning, the probabilities add up to one."""
    keys = pa.array([b"\x05abcde" + bytes((k,)) for k in range(256)], pa.binary())
    rng = np.random.default_rng(0)
    edges = context_mixing.Edges(keys, rng.integers(0, 3, 256).astype(float))
    mixer = context_mixing.Mixer(rng.integers(0, 3, (2, context_mixing.SLOTS)).astype(np.float16))
    last = edges.of[edges.spelled.starts + 5]
    assert abs((2.0 ** -mixer.costs(edges, last)).sum() - 1) < 1e-3


# ---------------------------------------------------------------- 6


def test_encoder_equals_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    texts = ["", " ", "  a", "a  b", "a \n b", "x <|endoftext|> y", "don't  we'll", "é ü  x", "😀 😀a", "\x1f a", "tail\x85 b", " lead word", "word " * 50, "a\tb c d"]
    for long_text in (4 << 20, 10):
        monkeypatch.setattr(packing, "LONG_TEXT", long_text)
        for text in texts:
            assert np.frombuffer(fast(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_whole_and_fits(lengths):
    counts = Counter(lengths)
    runs, bins, bound = packing.plan(dict(counts), capacity=20, nodes=20_000)
    filled, placed = Counter(), Counter()
    for size, first, last, start, each, offset in runs:
        for k in range(last - first):
            filled[start + k // each] += size
            placed[size] += 1
    assert placed == counts and len(filled) == bins and all(v <= 20 for v in filled.values())
    assert -(-sum(lengths) // 20) <= bound <= bins <= sum(n for _, n in packing.best_fit(counts, 20))


def fewest(lengths, capacity):
    """Bins of the best packing, by trying all."""
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for free in set(bins):
            if free >= lengths[k]:
                rest = list(bins)
                rest[rest.index(free)] -= lengths[k]
                put(k + 1, rest)
        put(k + 1, [*bins, capacity - lengths[k]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_plan_equals_brute_force(lengths):
    assert packing.plan(dict(Counter(lengths)), capacity=30, nodes=50_000)[1] == fewest(sorted(lengths, reverse=True), 30)


def test_fillings_are_undominated():
    found, _ = packing.fillings(10, [2, 3, 4, 6, 7], {2: 1, 3: 2, 4: 1, 6: 1, 7: 1})
    assert {sum(f) for f in found[:2]} == {10} and (7, 3) in found and (3, 3, 2) not in found


def test_pack(spark, nasty, empty):
    rows = packing.pack(nasty, ["doc_id"], packing.tokenizer_path(), with_ids=True).collect()
    spans = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        spans.setdefault(r["sequence_id"], []).append((r["offset"], len(r["ids"]) // 4))
    for found in spans.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len({r["doc_id"] for r in rows}) == 9 and packing.pack(empty, ["doc_id"], packing.tokenizer_path()).count() == 0


# ---------------------------------------------------------------- 7


def test_windows_in_texts_of_any_length(monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choices(["a", "b", "c", "é", "dd"], k=n))
    items = [("i1", text(40).encode()), ("i2", b"a b"), ("i3", text(12).encode()), ("i4", b"dd " * 30)]
    index = decontaminate.Index(items, 10, 3, lambda shingles: {w: np.arange(len(own)) % 3 for w, own in shingles.items()})
    whole = f"{text(200)} {items[0][1].decode()} {text(50)} {'dd ' * 25}{items[2][1].decode()}".encode()
    words, hit, names = whole.split(), set(), set()
    for name, data in items:
        own = data.split()
        n = min(10, len(own))
        for k in range(len(own) - n + 1):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    names.add(name)
    for part in (1 << 20, 300, 7):
        monkeypatch.setattr(decontaminate, "PART", part)
        for texts in ([whole], [b"", whole, b"a b a b"]):
            n, spans, found = index.find(texts)[texts.index(whole)]
            assert n == len(words) and found == names and {x for a, b in spans for x in range(a, b)} == hit


@pytest.mark.parametrize("max_index_bytes", [1 << 20, 60])
def test_decontamination(spark, nasty, empty, max_index_bytes):
    items = [("b1", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), ("b2", "short Item"), ("b3", "...  "), (None, "one two three"), ("b4", None), ("b2", "other one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["x " + items[0][1].upper() + " y", "alpha beta gamma delta epsilon zeta eta theta iota", "a short-item! one,two three", "nothing", None, "short item short item"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for r in decontaminate.decontaminate(frame, bench, max_index_bytes=max_index_bytes).collect():
        own, hit, names = words(texts[r["doc_id"]]), set(), set()
        for name, text in items:
            w = words(text)
            for k in range(max(1, len(w) - 9) if w else 0):
                n = min(10, len(w))
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[k : k + n]:
                        hit.update(range(at, at + n))
                        names.add(name or "")
        assert r["__n_words"] == len(own) and sum(s["end"] - s["start"] for s in r["__spans"]) == len(hit) and r["__items"] == sorted(names)
    assert decontaminate.decontaminate(nasty, bench).count() == N_ROWS and decontaminate.decontaminate(empty, bench).count() == 0
    assert {len(r["__spans"]) for r in decontaminate.decontaminate(nasty, bench.where("false")).collect()} == {0}


# ---------------------------------------------------------------- 9


def test_expressions():
    run = lambda text: licenses.evaluate(licenses.postfix(licenses._TOKEN.findall(text)))
    assert run("MIT OR GPL-3.0-only AND BSD-3-Clause") == ({"mit", "gpl-3.0-only", "bsd-3-clause"}, 1.0)
    assert run("(MIT OR GPL-3.0) AND BSD-3-Clause") == ({"mit", "gpl-3.0", "bsd-3-clause"}, 1.0)
    assert run("GPL-2.0 WITH Classpath-exception-2.0")[0] == {"gpl-2.0"} and run("GPL-2.0 AND MIT")[1] == 0.3
    assert run("MIT OR") == ({"mit"}, 1.0) and run("") is None and run("( (") is None and run("MIT AND (")[0] == {"mit"}
    assert run("MIT and later d")[0] == {"mit"} and run("mit or gpl-2.0 or you")[0] == {"mit", "gpl-2.0"}


def test_tags_have_their_own_places():
    text = "x SPDX-License-Identifier: MIT and later d, or SPDX-License-Identifier: GPL-2.0\nSPDX-License-Identifier: MIT AND SPDX-License-Identifier: ISC xspdx-license-identifier: BSD"
    found = licenses.scan(text.encode(), licenses.automaton())[1]
    assert [(w, label) for w, _, kind, label in found if kind == "tag"] == [(1, "mit"), (9, "gpl-2.0"), (15, "mit"), (20, "isc")]


def test_license_base_equals_brute_force(spark, nasty, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(["CC", "by", "general", "public", "license", "all", "rights", "reserved", "x-y", "é", "\n"], k=rng.randrange(60)))) for k in range(200)]
    machine = licenses.automaton()
    for limit in (4 << 20, 30):
        monkeypatch.setattr("factloom.llm.common.LONG_TEXT", limit)
        for _, text in rows:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            want = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
            n, found = licenses.scan(text.encode(), machine)
            assert n == len(words) and sorted((w, label) for w, _, kind, label in found if kind == "base") == want
    assert licenses.license_statements(nasty, ["doc_id"]).count() == N_ROWS


# ---------------------------------------------------------------- 10


def test_sharding(spark, nasty, empty):
    rows = shard.shard(nasty, shards=3, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in nasty.collect())
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert shard.shard(empty).count() == 0
    assert sorted(shard.fisher_yates(100, 1)) == list(range(100)) and shard.fisher_yates(100, 1) == shard.fisher_yates(100, 1)


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, nasty, empty, tmp_path):
    import corpus_pipeline

    nasty.select("item_id" if "item_id" in nasty.columns else F.lit("i").alias("item_id"), F.lit("naïve 4539 1488").alias("text")).limit(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    for source, expected in ((nasty, True), (empty, False)):
        docs = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == nasty.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (out.count() > 0) == expected and all(len(r["ids"]) == 4 * r["length"] for r in out.collect())


def test_pipeline_run_removes_its_files(spark, nasty, tmp_path):
    import corpus_pipeline
    from factloom.llm.common import session

    nasty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("b", "some item")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = session(spark).sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {None, 4, 5, 7, 8}
    assert not [x for x in set(os.listdir(folder)) - before if not x.startswith(("rdd-", "pieces-"))]
