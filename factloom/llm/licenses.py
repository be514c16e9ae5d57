"""License scans: phrases and identifier tags by one Aho-Corasick automaton, expressions by a shunting yard.

The automaton runs once over a text's words (lower case, one blank between them) and finds the base phrases, notice
phrases of well-known licenses, and the words of an identifier tag. Behind each tag, the expression is read from the
original text and parsed by operator precedence (WITH before AND before OR) into postfix order, which is evaluated
to the set of licenses it names and to how freely it lets one use the text (OR: the better, AND: the worse side).
An expression may be of any length. It ends where its grammar does, with its line, or at the next tag; behind an operator
in lower case, only a name that looks like a license (see _like_a_license) goes on with it, anything else is prose. Each
tag's labels stand at the tag's own place.

score: how sure it is that the text states a license, 1 - product of (1 - weight) over the distinct statements.
freedom (more than the contract asks): 0 to 1, the worst over all labels and expressions; null without any.

Edge cases: null and empty texts have no statements and score 0; a tag without a readable expression counts as the
label `unknown`; an expression that breaks off is evaluated as far as it goes. Repeated rows and null ids come out as
they came in; an empty table gives no rows. Columns other than the kept ones are never looked at; kept columns may not
be named __n_words or __found.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import arrow_map, binary_list, pieces, schema_with, table
from factloom.llm.decontaminate import _GAP, words_of

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by which well-known licenses are recognised, with their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "mit license": "mit",
    "licensed under the apache license": "apache-2.0",
    "apache license version 2 0": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl-2.0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "cc0": "cc0",
    "isc license": "isc",
    "unlicense": "unlicense",
    "gplv2": "gpl",
    "gplv3": "gpl",
    "lgplv3": "lgpl",
    "agplv3": "agpl",
    "gnu free documentation license": "gfdl",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons zero": "cc0",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "zlib license": "zlib",
    "artistic license": "artistic",
    "european union public licence": "eupl",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "open data commons attribution": "odc-by",
    "python software foundation license": "psf",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "server side public license": "sspl",
    "business source license": "busl",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx license identifier"
#: Weight of a statement, and how freely a family of licenses lets one use the text; unknown names count as 0.2.
WEIGHTS = {"tag": 0.95, "notice": 0.8, "base": 0.6}
FREEDOM = {"mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "unlicense": 1.0, "cc0": 1.0, "public": 1.0, "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.6, "lgpl": 0.5, "epl": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "proprietary": 0.0, "reserved": 0.0}
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_TAG = rb"(?<![0-9a-zA-Z\x80-\xff])spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier(?![0-9a-zA-Z\x80-\xff])"
_EXPRESSION = re.compile(rb"(?i)" + _TAG + rb"[\x20\t]*:?[\x20\t]*")
#: Names of well-known licenses; a version or a variant may follow.
_FAMILY = re.compile(r"(?i)(?:mit|isc|zlib|unlicense|x11|wtfpl|0bsd|bsd|apache|[al]?gpl|gfdl|mpl|epl|eupl|cddl|cc|cc0|bsl|ofl|odbl|artistic|psf|python|ms|sspl|busl|licenseref)(?:[0-9.+:-].*)?$")
_TOKEN_OR_END = re.compile(_TOKEN.pattern.encode() + rb"|[\r\n]")


def freedom_of(label: str) -> float:
    parts = label.split("-")
    for n in range(len(parts), 0, -1):
        if (known := FREEDOM.get("-".join(parts[:n]))) is not None:
            return known
    return 0.2


def _tokens(data: bytes, at: int) -> Iterator[str]:
    """Tokens from `at` to the end of the line or the next tag, read as they are asked for; they are ASCII."""
    for m in _TOKEN_OR_END.finditer(data, at):
        if m[0] in b"\r\n" or _EXPRESSION.match(data, m.start()):
            return
        yield m[0].decode()


def _like_a_license(token: str) -> bool:
    """A well-known name, or one with a digit or with a hyphen between capitalised parts, as identifiers have."""
    return bool(_FAMILY.match(token)) or bool(re.search(r"[0-9]|^[A-Z][A-Za-z]*-[A-Z]", token))


def postfix(tokens: Iterable[str]) -> list[str]:
    """Shunting yard: operands in order, each operator behind its two sides. Stops where the expression does."""
    out: list[str] = []
    held: list[str] = []
    operand, sure = True, True  # whether an operand comes next, and whether it may be any name
    for token in tokens:
        low = token.lower()
        if low in _PRECEDENCE:
            if operand:
                break
            while held and held[-1] != "(" and _PRECEDENCE[held[-1]] >= _PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            operand, sure = True, token != low or low == "with"
        elif token == "(":
            if not operand:
                break
            held.append(token)
        elif token == ")":
            if operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if not operand or not (sure or _like_a_license(token)):
                break
            out.append(low)
            operand, sure = False, True
    if operand:
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    out += [x for x in reversed(held) if x != "("]
    return out


def evaluate(order: list[str]) -> tuple[set[str], float] | None:
    """Licenses named and freedom of a postfix expression; None if there is nothing in it."""
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token not in _PRECEDENCE:
            stack.append(({token.rstrip("+")}, freedom_of(token)))
            continue
        if len(stack) < 2:
            return None
        (right, r), (left, l) = stack.pop(), stack.pop()  # noqa: E741
        # An exception only ever adds permissions and is no license of its own.
        stack.append((left, min(1.0, l + 0.1)) if token == "with" else (left | right, max(l, r) if token == "or" else min(l, r)))
    return stack[-1] if stack else None


def automaton() -> ahocorasick.Automaton:
    """Keys stand between blanks; values are (words of the phrase, its kinds and labels)."""
    said: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            said.setdefault(phrase, []).append((kind, label))
    out = ahocorasick.Automaton()
    for phrase, what in said.items():
        out.add_word(f" {phrase} ", (len(phrase.split()), len(phrase) + 2, what))
    out.make_automaton()
    return out


def scan(data: bytes | None, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int, str, str]]]:
    """Number of words and statements (first word, words, kind, label) of one text, in order."""
    found: list[tuple[int, int, str, str]] = []
    total, carry, longest = 0, [], 8
    for part in pieces(data or b"", _GAP):
        words = carry + words_of(part)
        base = total - len(carry)
        line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
        place = at = 0
        for end, (n, length, what) in sorted(machine.iter(line), key=lambda m: m[0] - m[1][1]):
            start = end - length + 1
            place += line.count(" ", at, start)
            at = start
            if place + n > len(carry):
                found += [(base + place, n, kind, label) for kind, label in what]
        total = base + len(words)
        carry = words[max(0, len(words) - longest) :]
    if places := sorted(w for w, _, kind, _ in found if kind == "tag"):
        found = [x for x in found if x[2] != "tag"]
        for at, m in zip(places, _EXPRESSION.finditer(data), strict=True):
            value = evaluate(postfix(_tokens(data, m.end())))
            found += [(at, 3, "tag", label) for label in sorted(value[0] if value else {"unknown"})]
            found.append((at, 3, "freedom", str(value[1] if value else 0.2)))
    return total, sorted(found)


_FOUND = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("kind", pa.string()), ("label", pa.string())]))


def license_statements(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, __n_words and __found: all statements with their first word, kind and label."""
    source = docs.select(*keep, docs[text].alias("__text"))

    def make():
        machine = automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            results = [scan(data, machine) for data in binary_list(batch.column(len(keep)))]
            found = pa.array([[{"word": w, "words": n, "kind": k, "label": x} for w, n, k, x in r[1]] for r in results], _FOUND)
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array([r[0] for r in results], pa.int64()), found], names=[*keep, "__n_words", "__found"])

        return step

    return arrow_map(source, make, schema_with(source, keep, "__n_words long, __found array<struct<word:long,words:long,kind:string,label:string>>"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = license_statements(table(spark, sf_dir, "documents"), ["doc_id"])
    of = lambda *kinds: F.filter("__found", lambda s: s["kind"].isin(*kinds))
    base, stated, free = of("base"), of("base", "notice", "tag"), of("freedom")
    labels = lambda s: F.array_join(F.array_sort(F.array_distinct(F.transform(s, lambda x: x["label"]))), ",")
    kinds = F.array_distinct(F.transform(stated, lambda x: F.struct(x["kind"], x["label"])))
    weight = lambda k: F.when(k == "tag", WEIGHTS["tag"]).when(k == "notice", WEIGHTS["notice"]).otherwise(WEIGHTS["base"])
    doubt = F.aggregate(kinds, F.lit(1.0), lambda p, x: p * (1 - weight(x["kind"])))
    freedoms = F.create_map(*(F.lit(x) for kv in FREEDOM.items() for x in kv))
    own = F.transform(F.filter(stated, lambda x: x["kind"] != "tag"), lambda x: F.coalesce(F.try_element_at(freedoms, x["label"]), F.try_element_at(freedoms, F.split(x["label"], "-")[0]), F.lit(0.2)))
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(stated).alias("labels"),
        (1 - doubt).alias("score"),
        F.array_min(F.concat(own, F.transform(free, lambda x: x["label"].cast("double")))).alias("freedom"),
    )
