"""Keyword search over a table of texts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import col

# The shortest term counted, how many hits are returned, and what
# separates terms.
MIN_TERM = 3
TOP_HITS = 3
SEPARATOR_PATTERN = r"[^a-z0-9²]+"


def search_terms(query: str) -> list[str]:
    return [t for t in re.split(SEPARATOR_PATTERN, query.lower().strip()) if len(t) >= MIN_TERM]


def search(
    df: DataFrame, query: str, texts: Sequence[str], order: str, topics: Sequence[str] = (),
    key: str | None = None, limit: int = TOP_HITS,
) -> DataFrame:
    """Rows named by topic first, then the best keyword matches.

    The score is how many query terms occur anywhere in the text columns. Ties
    follow ``order``. A repeated term counts as often as it is asked for.
    """
    hay = F.lower(F.concat_ws(" ", *[col(t) for t in texts]))
    hits_of = [F.col("_hay").contains(t).cast("int") for t in search_terms(query)]
    score = reduce(Column.__add__, hits_of, F.lit(0))
    scored = df.withColumn("_hay", hay).withColumn("score", score).drop("_hay")
    # dropping zero scores after the top-k keeps the scan to one projection per text
    hits = scored.orderBy(F.desc("score"), col(order)).limit(limit).filter("score > 0")
    if not topics or key is None:
        return hits
    listed = list(dict.fromkeys(topics))
    named = scored.filter(col(key).isin(listed))
    place = F.array_position(F.array(*map(F.lit, listed)), col(key))
    rest = hits.filter(~F.coalesce(col(key).isin(listed), F.lit(False)))
    return named.withColumn("_place", place).unionByName(rest.withColumn("_place", F.lit(len(listed) + 1))).orderBy(
        "_place", F.desc("score"), col(order)).drop("_place")
