"""A stored trigram index for repeated keyword searches.

Searching a table reads every text. The index keeps, for each three letters in a
row, the rows that hold them, in folders by trigram; the texts lie beside it in
folders by key. A search reads the postings of its own trigrams, knows from them
how many terms a row can hold at most, and verifies rows by their text from the
most promising down until no other row can enter the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyloom.functions.numeric import col
from surveyloom.operators.search import MIN_TERM, SEPARATOR_PATTERN, TOP_HITS, search_terms
from surveyloom.plans.scratch import discard, materialize

BUCKETS = 64
# Tasks, and files, that a folder is dealt to when it is written.
_SLICES = 8


def _hay(texts: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(" ", *[col(t) for t in texts]))


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, keys): the rows of each batch that hold a trigram inside a run of letters that a term can hold."""
    held = re.compile(SEPARATOR_PATTERN.replace("[^", "[").rstrip("+") + f"{{{MIN_TERM},}}").findall
    for batch in batches:
        place: dict[str, int] = {}
        found, counts = [], np.zeros(batch.num_rows, np.int64)
        for i, hay in enumerate(batch.column(1)):
            grams = {t[j:j + MIN_TERM] for t in set(held(hay.as_py())) for j in range(len(t) - MIN_TERM + 1)}
            counts[i] = len(grams)
            found.extend([place.setdefault(g, len(place)) for g in grams])
        gram = np.array(found, np.int64)
        order = np.argsort(gram, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(gram, minlength=len(place))))
        rows = np.repeat(np.arange(batch.num_rows), counts)[order]
        keys = pa.LargeListArray.from_arrays(pa.array(ends), batch.column(0).take(pa.array(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), keys.cast(pa.list_(keys.type.value_type))], names=["gram", "_keys"])


def term_grams(term: str) -> list[str]:
    return sorted({term[i:i + MIN_TERM] for i in range(len(term) - MIN_TERM + 1)})


@dataclass
class SearchIndex:
    spark: SparkSession
    path: str
    words: list[str]
    key: str
    buckets: int
    schema: T.StructType

    def _read(self, table: str) -> DataFrame:
        """A stored table; its schema is known, so an empty one reads as well."""
        keys = T.StructField("_keys", T.ArrayType(self.schema[self.key].dataType))
        fields = {"texts": list(self.schema.fields), "postings": [T.StructField("gram", T.StringType()), keys]}[table]
        whole = T.StructType([*fields, T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(f"{self.path}/{table}")

    def postings(self, grams: Sequence[str]) -> DataFrame:
        """(gram, key) of these trigrams, from their folders alone."""
        table = self._read("postings")
        wanted = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(
            _bucket(F.col("gram"), self.buckets)).distinct().collect()]
        return table.filter(F.col("bucket").isin(wanted) & F.col("gram").isin(list(grams))).select("gram", F.explode("_keys").alias("_key"))

    def texts(self, keys: DataFrame) -> DataFrame:
        """The stored rows of these keys, from the folders they lie in."""
        table = self._read("texts")
        folders = [r[0] for r in keys.select(_bucket(F.col("_key"), self.buckets)).distinct().collect()]
        return table.filter(F.col("bucket").isin(folders)).drop("bucket").join(
            keys.withColumnRenamed("_key", self.key), self.key, "left_semi")

    def candidates(self, terms: Sequence[str]) -> DataFrame:
        """(_key, _most): the number of terms, repeats included, that a row's trigrams leave possible."""
        asked = {t: terms.count(t) for t in terms}
        needs = {t: term_grams(t) for t in asked}
        grams = sorted({g for gs in needs.values() for g in gs})
        held = self.postings(grams).groupBy("_key").agg(*[
            F.bool_or(F.col("gram") == g).alias(f"g{i}") for i, g in enumerate(grams)])
        place = {g: F.col(f"g{i}") for i, g in enumerate(grams)}
        possible = [reduce(Column.__and__, [place[g] for g in gs]).cast("int") * asked[t] for t, gs in needs.items()]
        return held.select("_key", reduce(Column.__add__, possible).alias("_most")).filter("_most > 0")

    def search(self, query: str, order: str | None = None, limit: int = TOP_HITS) -> DataFrame:
        """The rows ``search`` finds over the whole table: most terms first, ties by ``order`` (the key by default).

        Rows are verified level by level of what they can hold at most, so a
        level is read only while it can still change the result.
        """
        order = order or self.key
        terms = search_terms(query)
        if not terms:
            return self._read("texts").drop("bucket").withColumn("score", F.lit(0)).limit(0)
        rows = materialize(self.candidates(terms), "candidates")
        levels = [r["_most"] for r in rows.select("_most").distinct().orderBy(F.desc("_most")).collect()]
        score = reduce(Column.__add__, [_hay(self.words).contains(t).cast("int") for t in terms])
        best, taken = None, []
        for level, below in zip(levels or [0], [*levels[1:], 0], strict=True):
            found = self.texts(rows.filter(F.col("_most") == level).select("_key")).withColumn("score", score)
            ranked = found if best is None else best.unionByName(found)
            best = materialize(ranked.filter("score > 0").orderBy(F.desc("score"), col(order)).limit(limit), "best")
            taken.append(best)
            scores = sorted((r["score"] for r in best.select("score").collect()), reverse=True)
            if len(scores) == limit and scores[-1] > below:
                break
        discard(rows, *taken[:-1])
        return best.orderBy(F.desc("score"), col(order))


def build_index(df: DataFrame, path: str, texts: Sequence[str], key: str, buckets: int = BUCKETS) -> SearchIndex:
    """Write the index of ``df`` to ``path`` and return it.

    Rows that share a key are found together; a row without a key cannot be
    looked up and is an error. A posting is a trigram with its rows of one batch, so
    what is dealt out and sorted is far fewer rows than trigrams and rows pair up to,
    and those of a trigram that most texts hold stay many small ones.
    """
    if any(c in df.columns for c in ("_key", "score", "bucket")):
        raise ValueError("columns _key, score and bucket are the index's own")
    if not df.filter(col(key).isNull()).isEmpty():
        raise ValueError(f"rows without {key} cannot be indexed")
    stored = df.withColumn("bucket", _bucket(col(key), buckets))
    stored.repartition("bucket", _bucket(F.struct(col(key)), _SLICES)).write.partitionBy("bucket").parquet(f"{path}/texts")
    index = SearchIndex(df.sparkSession, path, list(texts), key, buckets, df.schema)
    kind = T.StructType([T.StructField("gram", T.StringType()), T.StructField("_keys", T.ArrayType(df.schema[key].dataType))])
    grams = index._read("texts").select(col(key).alias("_key"), _hay(texts).alias("hay")).mapInArrow(_postings, kind).withColumn(
        "bucket", _bucket(F.col("gram"), buckets))
    (grams.repartition("bucket", _bucket(F.struct("gram"), _SLICES)).sortWithinPartitions("bucket", "gram")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    return index
