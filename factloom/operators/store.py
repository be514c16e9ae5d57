"""The knowledge base's tables: upserts, the attribute registry, cascades, incremental ingest, backfill, crops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.functions import values as V

TABLES = ["documents", "facts", "relations", "open_questions", "schema_registry"]


def upserted(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """stored with the rows of fresh in place of those of the same key."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def registry(inserts: DataFrame) -> DataFrame:
    """attribute, first_seen, count of all inserts ever made (seq: their order), replaced facts included."""
    return inserts.groupBy(V.strip(F.lower("attribute")).alias("attribute")).agg(F.min_by("doc", "seq").alias("first_seen"), F.count("*").alias("count"))


def registry_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.select("*", F.lit(0).alias("o")).unionByName(new.select("*", F.lit(1).alias("o")))
    return both.groupBy("attribute").agg(F.min_by("first_seen", "o").alias("first_seen"), F.sum("count").alias("count"))


def changed_documents(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (doc, sha) whose content isn't stored yet."""
    return found.join(stored.select("doc", "sha"), ["doc", "sha"], "left_anti")


def delete_document(tables: dict[str, DataFrame], doc: str) -> dict[str, DataFrame]:
    """The tables without a document and what hangs on its facts. The registry stays, and so do questions without facts."""
    gone = tables["facts"].where(F.col("doc") == doc).select("fact_id")
    relations = tables["relations"]
    for side in ("fact_a", "fact_b"):
        relations = relations.join(gone.select(F.col("fact_id").alias(side)), side, "left_anti")
    touched = tables["open_questions"].select("id", F.explode("fact_ids").alias("fact_id")).join(gone, "fact_id", "left_semi").select("id").distinct()
    return tables | {
        "documents": tables["documents"].where(F.col("doc") != doc),
        "facts": tables["facts"].where(F.col("doc") != doc),
        "relations": relations.select(*tables["relations"].columns),
        "open_questions": tables["open_questions"].join(touched, "id", "left_anti"),
    }


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: rows.limit(0) for name, rows in tables.items()}


def backfilled(facts: DataFrame) -> DataFrame:
    """facts with values that can be read now, where a number had none."""
    again = V.normalize_value(F.coalesce("value_raw", F.lit("")), F.coalesce("unit_norm", F.lit("")), F.coalesce("quote", F.lit("")))
    rows = facts.withColumn("__v", F.when((F.col("fact_type") == "numeric") & F.col("value_norm").isNull(), again))
    read = F.col("__v.value_norm").isNotNull()
    return rows.withColumns({"value_norm": F.coalesce("value_norm", "__v.value_norm"), "unit_norm": F.when(read, F.col("__v.unit_norm")).otherwise(F.col("unit_norm"))}).drop("__v")


def pages_without_crop(facts: DataFrame) -> DataFrame:
    """Each page that is still to be rendered, once, with the facts it is for."""
    return facts.where(F.coalesce("crop", F.lit("")) == "").groupBy("doc", "page_index").agg(F.sort_array(F.collect_list("fact_id")).alias("fact_ids"), F.concat(F.substring(F.first("doc"), 1, 8), F.lit("-p"), F.first("page_index").cast("string"), F.lit(".png")).alias("file"))


def with_crops(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """questions whose evidence without a crop gets the first crop among their facts (in the order of fact_ids)."""
    drawn = facts.where(F.coalesce("crop", F.lit("")) != "").select("fact_id", F.col("crop").alias("c"))
    first = questions.select("id", F.posexplode("fact_ids").alias("p", "fact_id")).join(drawn, "fact_id").groupBy("id").agg(F.min_by("c", "p").alias("__c"))
    filled = F.transform("evidence", lambda e: e.withField("crop", F.coalesce(F.when(e["crop"] != "", e["crop"]), F.col("__c"), e["crop"])))
    return questions.join(first, "id", "left").withColumn("evidence", filled).drop("__c")


def cache_key(version: str, model: str, sha, doc, entity, page, text):
    """Key of a chunk's extraction."""
    parts = [F.lit(version), F.lit(model), sha, doc, F.coalesce(entity, F.lit("")), page.cast("string"), F.coalesce(text, F.lit(""))]
    return F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, 32)


def cache_split(chunks: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with what was kept, misses)."""
    return chunks.join(cache, key), chunks.join(cache.select(key), key, "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


class Store:
    """Tables as Parquet below one path.

    Each writing of a table makes a new version, a folder `name.<number>`; a version is there once Spark's writer has marked it
    complete, and readers take the last such one. So a table is never half written and never away; older versions are removed
    after a new one is complete.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.root = self.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        found = self.files.globStatus(self.fs.Path(f"{self.path}/{name}.*/_SUCCESS")) or []
        return sorted(int(x.getPath().getParent().getName().rpartition(".")[2]) for x in found)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.{self._versions(name)[-1]:06d}")

    def write(self, name: str, rows: DataFrame) -> None:
        """rows may read the version before."""
        known = self._versions(name)
        fresh = known[-1] + 1 if known else 1
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}.{fresh:06d}")
        for old in known:
            self.files.delete(self.fs.Path(f"{self.path}/{name}.{old:06d}"), True)

    def ingest(self, documents: DataFrame, facts: DataFrame, questions: DataFrame) -> None:
        """Puts the documents, their facts and their questions (with `doc`) in the place of what is stored of these documents.

        Documents are written last: what breaks off in between is found changed again by the next run, which replaces its own
        rows. The registry counts every fact that was ever put in, also those that were replaced since. Questions get ids that
        go on from the largest one stored.
        """
        docs = documents.select("doc")
        counted = registry(facts.withColumn("seq", F.struct("doc", "fact_id")))
        last = 0
        if self.exists("facts"):
            facts = self.read("facts").join(docs, "doc", "left_anti").unionByName(facts, allowMissingColumns=True)
        stored = None
        if self.exists("open_questions"):
            stored = self.read("open_questions")
            last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        questions = with_ids(questions, last)
        if stored is not None:
            questions = stored.join(docs, "doc", "left_anti").unionByName(questions, allowMissingColumns=True)
        if self.exists("documents"):
            documents = upserted(self.read("documents"), documents, "doc")
        if self.exists("schema_registry"):
            counted = registry_merged(self.read("schema_registry"), counted)
        self.write("schema_registry", counted)
        self.write("facts", facts)
        self.write("open_questions", questions)
        self.write("documents", documents)

    def link(self, relate, **how) -> None:
        """Works out the relations of all stored facts anew: relate(facts, documents, **how)."""
        self.write("relations", relate(self.read("facts"), self.read("documents"), **how))

    def delete(self, doc: str) -> None:
        """Removes a document and what hangs on its facts."""
        names = ["relations", "open_questions", "facts", "documents"]
        left = delete_document({name: self.read(name) for name in names}, doc)
        # What hangs on the facts is written before them, as it is found by the facts that go.
        for name in names:
            self.write(name, left[name])

    def stats(self) -> DataFrame:
        """Rows of each table that is there."""
        return table_counts({name: self.read(name) for name in TABLES if self.exists(name)})


def with_ids(questions: DataFrame, last: int = 0) -> DataFrame:
    """questions with `id`, from last + 1: those of a partition go on from where the partitions before end."""
    rows = questions.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id())
    kept = rows.checkpoint() if questions.sparkSession.sparkContext.getCheckpointDir() else rows.persist()
    sizes = {r["__part"]: r["count"] for r in kept.groupBy("__part").count().collect()}  # one row a partition
    before, at = {}, last
    for part in sorted(sizes):
        before[part], at = at, at + sizes[part]
    begins = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(-1), F.lit(last))
    place = F.col("__in").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("id", (F.element_at(begins, F.col("__part")) + place + 1).cast("long")).drop("__part", "__in")


def document_rows(pages: DataFrame, shas: DataFrame, entities: DataFrame) -> DataFrame:
    """doc, sha, pages, entity, vintage."""
    seen = pages.groupBy("doc").agg(F.count("*").cast("int").alias("pages"), F.max(F.array_max(T.content_years(F.col("markdown")))).alias("year"))
    return seen.join(shas, "doc").join(entities, "doc", "left").select("doc", "sha", "pages", F.coalesce("entity", F.lit("")).alias("entity"), T.vintage(F.col("year"), F.col("doc")).alias("vintage"))
