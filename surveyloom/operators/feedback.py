"""Batch upkeep of an event table: newest per event, copies, removal of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.numeric import col
from surveyloom.functions.ordering import earliest, latest


def latest_per_event(df: DataFrame, event: str = "event_id", at: str = "created_at") -> DataFrame:
    """The newest row of every event, a row without a time if there is no other; partial maxima keep a busy event cheap."""
    return df.groupBy(col(event).alias("_event")).agg(latest(df, at).alias("r")).select("r.*")


def copies(df: DataFrame) -> DataFrame:
    """Events recorded more than once with the same rating and reason."""
    return (
        df.groupBy("event_id", "rating", F.coalesce("reason", F.lit("")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("created_at").alias("first_seen"),
             F.max("created_at").alias("last_seen"))
        .filter("copies > 1").orderBy(F.desc("copies"), "first_seen", "event_id", "rating", "reason")
    )


def without_copies(df: DataFrame, row_id: str) -> DataFrame:
    """Keep the earliest of identical rows; only rows without a client key may go.

    A keyless row goes when any earlier row has its identity, keyed or not, so
    exactly the keyless rows that are first of their identity stay. A null
    event or rating equals nothing and always stays.
    """
    comparable = F.col("event_id").isNotNull() & F.col("rating").isNotNull()
    untouched = df.filter(F.col("client_key").isNotNull() | ~comparable)
    firsts = (
        df.filter(comparable)
        .groupBy(F.col("event_id").alias("_e"), F.col("rating").alias("_r"),
                 F.coalesce("reason", F.lit("")).alias("_s"), F.coalesce("user_message", F.lit("")).alias("_m"))
        .agg(earliest(df, row_id).alias("r")).select("r.*").filter("client_key is null")
    )
    return untouched.unionByName(firsts)
