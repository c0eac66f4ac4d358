"""A training corpus from raw documents: language ID, near-duplicate removal, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the columns
of documents; only the last one's rows are what `run` returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake._ship import ship
from quadlake.llm import decontam, lang_id, mixing, ngram_join, sharding
from quadlake.llm._common import read, stash

#: Keys that are looked up by broadcasting them.
BROADCAST_ROWS = 500_000


def _aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with names of no meaning to the operators for all columns but the used ones, and the expressions that bring the old names back:
    columns that are named like an operator's own pass through unharmed."""
    names = {c: c if c in used else f"kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def _checked(keys: DataFrame) -> DataFrame:
    """A written table of two numbers a row, marked for broadcast if it has no more than BROADCAST_ROWS (8 MB); else the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, in none of the known ones, or without one that the evidence settles on, go. The source serves as the
    host.

    Null, empty and letterless texts go; rows that repeat an id or a text are judged each by their text and host, and so alike; without
    labelled rows no language is known and all go; an empty table gives none.
    """
    ship(spark)
    model = lang_id.train(docs)
    narrow = docs.select("doc_id", F.col("source").alias("from"), "text")
    evidence = lambda d: lang_id.evidence_columns(d, declared=F.lit(None).cast("string"), host=F.col("from"))
    scored = stash(lang_id.score(evidence(narrow), model).drop("text"), "languages")
    rows, back = _aside(docs, "text")
    rows = rows.withColumn("from", back[docs.columns.index("source")])
    found = lang_id.identify(evidence(rows), model, lang_id.Evidence(scored, model[0]))
    return found.filter("accepted").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest id stays, and of several with that id one.

    Texts without words and rows without an id are in no group and stay, repeated or not; an empty table gives none.
    """
    ship(spark)
    found = stash(ngram_join.near_duplicates(docs).filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("group_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")), "groups")
    first = found.groupBy("group_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    marked = found.join(stash(first, "firsts"), "group_key").withColumn("stays", F.col("first") == F.struct("doc_id", "text_hash"))
    gone = _checked(stash(marked.filter("NOT stays").select("doc_id", F.col("text_hash").alias("kept_hash")), "near-duplicates"))
    twice = _checked(stash(marked.filter("stays AND n > 1").select("doc_id", F.col("text_hash").alias("kept_hash")), "repeated-rows"))
    key = ["doc_id", "kept_hash"]
    rows, back = _aside(docs, "doc_id", "text")
    left = rows.withColumn("kept_hash", F.xxhash64("text")).join(gone, key, "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, key, "left_anti").unionByName(left.join(twice, key, "left_semi").dropDuplicates(key))
    return left.select(*back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text, words substituted or not, go.

    Null and empty texts stay; rows that repeat an id or a text stay or go by their text; without benchmark texts all stay; an empty table
    gives none.
    """
    ship(spark)
    rows, back = _aside(docs, "text")
    found = decontam.find_leaks(rows, read(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources enter by weight, at most twice over; a document that enters twice is two rows.

    A null source is a source; null and empty texts count no words, so that they may enter once more than
    the cap says; rows that repeat an
    id are taken together; an empty table gives none.
    """
    ship(spark)
    rows, back = _aside(docs, "doc_id", "text", "source")
    return mixing.repeat(mixing.mix(rows, mixing.weights_313)).select(*back)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row in 24 shards that all match the mixture. Null texts have no bytes, null sources are a source, repeated rows
    have places of their own; an empty table gives none."""
    ship(spark)
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: SQL expresses neither the language model nor spaced-seed search; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"stage-{i}")
    return docs
