"""Personal data: base patterns, and identifiers found by bootstrapping over the contexts of those.

All of it is DataFrame operations. The seeds are the base matches (email, ip, card, phone) and secrets that show by
themselves: long strings of letters and digits in which neither is rare (see SECRET). The lexical pattern of a mention
is the word before it (with the name before a bare `=` or `:`). Mentions that look like identifiers (they hold a digit)
are instances. Patterns and instances form a graph whose edges are the pairs seen in the corpus, with their counts.
In each of ROUNDS rounds

    score(pattern)  = sum over its edges of count * score(instance) / occurrences of the pattern in the corpus,
    score(instance) = 1 for a seed, else 1 - product over its patterns of (1 - score(pattern)),

where only patterns of at least SUPPORT different instances that score CONFIDENT or more, and with a score of
CONFIDENT or more, vouch for instances. Instances that score CONFIDENT in the end, and seeds that aren't base matches,
are spans of the kind `id`. Both sides count all rows: an edge counts as often as rows hold its text, and the occurrences
are those of all words of all rows, whether an identifier follows or not, so that frequent words vouch for nothing.

Equal texts are looked at once. A text is split at its matches; the matches become rows with the lengths between them,
and where each stands is a running sum over its text's rows. So are the tests for overlaps. The expressions are
possessive: none of them goes back over what it has read. The pattern of a mention is read from what lies between it and
the match of its kind before it, that match included. So a text takes time in proportion to its length.

Edge cases: null and empty texts have no spans; equal texts get the same spans each; null ids stay; an empty table
gives no rows. Other columns of the input, of whatever name and type, are carried through and never looked at; only
columns that begin with `__` may be replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, session, table

KINDS = ["email", "ip", "card", "phone", "id"]
ROUNDS = 3
SUPPORT = 3
CONFIDENT = 0.5
#: A side of a join with no more rows than this (of under 100 bytes), or no more spans, may go to every task.
SMALL_ROWS = 100_000
#: An instance that is a secret by itself: at least 20 characters of which at least 5 are digits and 5 are letters.
SECRET = r"^(?=(?:[^0-9]*[0-9]){5})(?=(?:[^A-Za-z]*[A-Za-z]){5})[A-Za-z0-9_+/=-]{20,}$"
#: Texts with spans are cut into blocks of so many characters, so that a place in them is found at once.
BLOCK_CHARS = 1024

#: The base patterns. A run of the first characters that doesn't lead to a match from its start leads to none from
#: within, so matches begin at the start of a run or where the last one ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Words (or what follows a quote, bracket, `=` or `:`) that hold a digit.
INSTANCE = r"(?<![^\s=:\"'(<\[])[^\s=:\"'(<\[0-9]*+[0-9][^\s\"')>\],;]*+"
_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _bind(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def _context(before: Column) -> Column:
    """The lexical pattern at the end of `before`: the last word, or a name and the sign after it; lower case."""
    return F.regexp_extract(F.lower(F.right(before, F.lit(80))), r"(\S{1,32}\s+[=:#>-]{1,3}|\S{1,32})[\s\"'(<\[]*$", 1)


_MATCH = "array<struct<kind:string,nth:int,gap:int,size:int,own:int,value:string,context:string,ok:boolean>>"


def _matches(text: Column, kind: str, pattern: str, likely: Column, ok, tidy=lambda v: v) -> Column:
    """The leftmost non-overlapping matches: characters since the last one (gap), characters read (size) and meant (own)."""
    pairs = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))

    def row(p: Column, m: Column, i: Column) -> Column:
        gap = F.get(p["b"], i)
        before = F.when(i > 0, F.concat(F.get(p["m"], i - 1), gap)).otherwise(gap)
        return _bind(tidy(m), lambda v: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(gap).alias("gap"), F.length(m).alias("size"), F.length(v).alias("own"), v.alias("value"), _context(before).alias("context"), ok(v).alias("ok")))

    return F.when(likely, _bind(pairs, lambda p: F.transform(p["m"], lambda m, i: row(p, m, i))).cast(_MATCH)).otherwise(F.array().cast(_MATCH))


def found_in(text: Column) -> Column:
    """All matches of a text that isn't null, kind after kind."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    return F.concat(
        _matches(text, "email", EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        _matches(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")),
        _matches(text, "card", CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), lambda v: F.length(digits(v)).between(12, 19) & F.call_function("luhn_check", digits(v))),
        _matches(text, "phone", PHONE, F.contains(text, F.lit("+")), lambda v: F.length(digits(v)).between(9, 15)),
        _matches(text, "id", INSTANCE, text.rlike("[0-9]"), lambda v: F.length(v) >= 5, lambda v: F.regexp_replace(v, r"[.!?:\]]+$", "")),
    )


def text_key(text: Column) -> list[Column]:
    """96 bits of a text."""
    return [F.xxhash64(text).alias("__k1"), F.hash(F.lit(17), text).alias("__k2")]


def _mentions(docs: DataFrame, text: str) -> DataFrame:
    """A row for each base match and each instance apart from those: __k1, __k2 (of the text), start, end, kind, value, context, times."""
    key = ["__k1", "__k2"]
    found = docs.where(F.col(text).rlike("[0-9@]")).select(*text_key(F.col(text)), found_in(F.col(text)).alias("__found")).where(F.size("__found") > 0)
    # Copies meet as one row a task.
    texts = found.groupBy(*key).agg(F.first("__found").alias("__found"), F.count("*").alias("times"))
    rows = texts.select(*key, "times", F.explode("__found").alias("m")).select(*key, "times", "m.*")
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(*key, "kind").orderBy("nth"))
    rows = rows.withColumn("start", so_far - F.col("size")).withColumn("end", F.col("start") + F.col("own")).where("ok")
    base = lambda c: F.when(F.col("kind") != "id", F.col(c))
    before = F.max(base("end")).over(Window.partitionBy(*key).orderBy("start"))
    behind = F.min(base("start")).over(Window.partitionBy(*key).orderBy(F.desc("start")))
    rows = rows.withColumns({"before": before, "behind": behind})
    apart = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("behind", F.col("end")) >= F.col("end"))
    return rows.where((F.col("kind") != "id") | apart).select(*key, "start", "end", "kind", "value", "context", "times")


def _said(words: DataFrame, texts: DataFrame, text: str, n: int) -> DataFrame:
    """(context, said) of n words: how often each stands in the texts; 0 where it is part of a longer one."""
    if not n:
        return words.withColumn("said", F.lit(0).cast("long"))
    side = F.broadcast(words) if n <= SMALL_ROWS else words
    every = texts.select(F.explode(F.split(F.lower(F.col(text)), r"[\s\"'(<\[]+")).alias("context"))
    counted = every.join(side, "context", "left_semi").groupBy("context").agg(F.count("*").alias("said"))
    return words.join(counted, "context", "left").select("context", F.coalesce("said", F.lit(0)).alias("said"))


def bootstrap(mentions: DataFrame, texts: DataFrame, text: str, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(value, score) of the instances, no base matches, that are identifiers. mentions: value, kind, context, times."""
    secret = (F.col("kind") == "id") & F.col("value").rlike(SECRET)
    edges = cut(mentions.groupBy("context", F.lower("value").alias("value")).agg(F.sum("times").alias("n"), F.max((F.col("kind") != "id").cast("double")).alias("base"), F.max(((F.col("kind") != "id") | secret).cast("double")).alias("seed")))
    # Patterns whose trust is too low even by the instances seen behind them never vouch; of the others, how often the word
    # stands in the corpus is counted when a round first finds them. Signs such as `name =` are only ever counted before
    # instances.
    seen = edges.groupBy("context").agg(F.sum("n").alias("seen"))
    edges = cut(edges.join(seen, "context"))
    scores = edges.groupBy("value").agg(F.max("seed").alias("score"))
    named = F.col("context") != ""
    said = None
    for _ in range(rounds):
        weighed = edges.join(scores, "value")
        patterns = weighed.where(named).groupBy("context").agg(F.sum(F.col("n") * F.col("score")).alias("sum"), F.max("seen").alias("seen"), F.sum((F.col("score") >= confident).cast("int")).alias("k"))
        patterns = cut(patterns.where((F.col("sum") / F.col("seen") >= confident) & (F.col("k") >= support)))
        words = patterns.where(~F.col("context").rlike(r"\s")).select("context")
        words = cut(words if said is None else words.join(said, "context", "left_anti"))
        if (n := words.count()) or said is None:
            fresh = _said(words, texts, text, n)
            said = cut(fresh if said is None else said.unionByName(fresh))
        patterns = patterns.join(said, "context", "left").withColumn("trust", F.col("sum") / F.greatest("seen", F.coalesce("said", F.lit(0))))
        patterns = patterns.where(F.col("trust") >= confident).select("context", F.least("trust", F.lit(0.999)).alias("trust"))
        vouched = edges.join(patterns, "context", "left").groupBy("value").agg(F.max("seed").alias("seed"), F.sum(F.log(1 - F.coalesce("trust", F.lit(0.0)))).alias("doubt"))
        scores = cut(vouched.select("value", F.when(F.col("seed") > 0, 1.0).otherwise(1 - F.exp("doubt")).alias("score")))
    fresh = edges.groupBy("value").agg(F.max("base").alias("base")).where("base = 0")
    return scores.where(F.col("score") >= confident).join(fresh, "value", "left_semi")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each distinct text with spans: __k1, __k2 (see text_key) and __spans, array<struct<start,end,kind,prior>>.

    They are ordered by start and kind; prior is the largest end of those before, 0 at first.
    """
    session(docs.sparkSession)
    key = ["__k1", "__k2"]
    mentions = cut(_mentions(docs, text))
    known = bootstrap(mentions, docs, text)
    fresh = mentions.where("kind = 'id'").withColumn("value", F.lower("value")).join(known, "value", "left_semi")
    spans = mentions.where("kind <> 'id'").unionByName(fresh).withColumn("o", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    prior = F.max("end").over(Window.partitionBy(*key).orderBy("start", "o").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("prior", F.coalesce(prior, F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "o", F.col("end").cast("long").alias("end"), "kind", F.col("prior").cast("long").alias("prior"))))
    return spans.groupBy(*key).agg(F.transform(ordered, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"), m["prior"].alias("prior"))).alias("__spans"))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __spans, null where there are none."""
    found = cut(personal_data(docs, text))
    size = found.agg(F.coalesce(F.sum(F.size("__spans")), F.lit(0))).first()[0]
    side = F.broadcast(found) if size <= SMALL_ROWS else found
    one, two = text_key(F.col(text))
    return docs.drop("__spans").withColumns({"__k1": one, "__k2": two}).join(side, ["__k1", "__k2"], "left").drop("__k1", "__k2")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span (overlapping ones as one) of the text replaced by its kind in brackets."""
    names = docs.columns
    found = with_spans(docs, text)
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))

    def part(b: Column, start: Column, end: Column | None = None) -> Column:
        """The characters from start to end, out of the blocks that hold them."""
        first = F.floor(start / BLOCK_CHARS).cast("int")
        count = F.size(b) if end is None else F.floor(end / BLOCK_CHARS).cast("int") - first + 1
        own, at = F.array_join(F.slice(b, first + 1, count), ""), (start % BLOCK_CHARS).cast("int") + 1
        return F.substr(own, at) if end is None else F.substr(own, at, (end - start).cast("int"))

    def hidden(b: Column) -> Column:
        one = lambda s: F.when(s["start"] >= s["prior"], F.concat(part(b, s["prior"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        last = F.element_at("__spans", -1)
        return F.concat(F.array_join(F.transform("__spans", one), ""), part(b, F.greatest(last["prior"], last["end"])))

    text_of = _bind(blocks, hidden)
    return found.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(text_of)).select(*names)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs)
    spans = F.coalesce("__spans", F.array().cast("array<struct<start:long,end:long,kind:string,prior:long>>"))
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(said(F.filter(spans, lambda s: s["kind"] != "id")).cast("binary"), 256).alias("base_sha256"), said(spans).alias("spans"), of("id").alias("n_id"), F.size(spans).cast("long").alias("n_spans"))
