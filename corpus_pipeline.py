"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next stage's docs. All but the last keep the
columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import decontaminate, language, packing, shingles, simhash, sparse_suffixes
from surveyloom.llm.queries import VOCABULARY, piece_digests
from surveyloom.plans.scratch import materialize


def unused_name(docs: DataFrame, name: str) -> str:
    """The name with as many underscores before it as no column of ``docs`` has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter go. The label of those that stay is not changed.

    Where no row has a language to learn from, every label found is ``und``; lettered documents stay all the same.
    """
    others = [c for c in docs.columns if c != "doc_id"]
    places = {"doc_id": "_0"} | {c: f"_{i}" for i, c in enumerate(others, 3)}
    found = language.identify(docs, carry=tuple(others)).toDF(*[f"_{i}" for i in range(3 + len(others))])
    lettered = F.col(places["text"]).rlike(r"\p{L}")
    return found.filter((F.col("_1") != language.UNKNOWN) | lettered).select(*[F.col(places[c]).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Pairs come from the Gray-order index of SimHash fingerprints and, for those that differ in more bits, from
    buckets of least hashes; both are confirmed on whole sets of five-word shingles, of which two texts of a
    group's link share 0.8 or more.
    """
    return shingles.keep_one(docs, candidates=simhash.text_pairs(docs))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages cut out of all but the first document; documents that lose all words go."""
    spans, left = (unused_name(docs, n) for n in ("cut_spans", "words_left"))
    cut = sparse_suffixes.cut_repeats(docs, spans, left).filter(F.col(left))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = materialize(found.filter(F.size("spans") > 0).select("doc_id", "text_hash").distinct(), "contaminated")
    same = F.expr("cast(d.doc_id as bigint) <=> h.doc_id and xxhash64(d.text) = h.text_hash")
    return docs.alias("d").join(hit.alias("h"), same, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the sequences."""
    return piece_digests(packing.pack_documents(docs, VOCABULARY))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", passage_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

# Language identification and tokenisation are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
