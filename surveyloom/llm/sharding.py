"""Shards by a weighted hash tree, and gapless places in each shard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.plans.scratch import materialize

PIECES = 256  # a shard is numbered in this many pieces, so that no task holds a whole shard


@dataclass(frozen=True)
class Place:
    """A shard with its place in the tree. Shards added later carry a later generation."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0
    generation: int = 0


def layout(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Place]:
    """Equal shards laid out in order, racks and regions filled one after another."""
    per_region = per_rack * racks_per_region
    return [Place(s, s // per_region, s // per_rack) for s in range(shards)]


def grown(tree: Sequence[Place], weight: float = 1.0) -> list[Place]:
    """The tree with one more shard, in the region and rack with the fewest shards, as its own generation."""
    sizes = {(p.region, p.rack): sum(q.rack == p.rack for q in tree) for p in tree}
    region, rack = min(sizes, key=lambda k: (sizes[k], k)) if sizes else (0, 0)
    number = 1 + max((p.shard for p in tree), default=-1)
    return [*tree, Place(number, region, rack, weight, 1 + max((p.generation for p in tree), default=-1))]


def _pick(key: Column, level: str, branches: Column) -> Column:
    """The target of the branch with the least weighted draw.

    A draw u in (0, 1) is fixed by the key and the branch. -ln(u) / weight is
    least with a chance in proportion to the weight, and a branch that is added
    or gains weight can only win keys, never deal them between the others.
    """
    def race(branch: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), branch["generation"], branch["name"]), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((-F.log(u) / branch["weight"]).alias("race"), branch["target"].alias("target"))

    return F.array_min(F.transform(branches, race))["target"]


def _branches(entries: Sequence[tuple[int, int, float, int]]) -> Column:
    names = ("generation", "name", "weight", "target")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, e, strict=True)]) for e in entries])


def shard_of(key: Column, tree: Sequence[Place]) -> Column:
    """The shard of each key: a draw among regions, then racks, then shards.

    A region takes part once for each generation of shards in it, so a shard
    added later opens a branch of its own and takes keys only into itself. A
    changed weight moves keys only into or out of the branches above it.
    """
    if not tree or any(p.weight <= 0 for p in tree):
        raise ValueError("a tree needs shards, all with positive weights")
    tops, racks, shards = [], [], []
    in_order = sorted(tree, key=lambda p: (p.generation, p.region, p.rack, p.shard))
    for (generation, region), inside in groupby(in_order, key=lambda p: (p.generation, p.region)):
        below = []
        for rack, leaves in groupby(inside, key=lambda p: p.rack):
            leaves = [(generation, p.shard, float(p.weight), p.shard) for p in leaves]
            below.append((generation, rack, sum(e[2] for e in leaves), len(shards)))
            shards.append(_branches(leaves))
        tops.append((generation, region, sum(e[2] for e in below), len(racks)))
        racks.append(_branches(below))
    region = _pick(key, "region", _branches(tops))
    rack = _pick(key, "rack", F.element_at(F.array(*racks), region + 1))
    return _pick(key, "shard", F.element_at(F.array(*shards), rack + 1)).cast("int")


def with_slots(table: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Each shard is cut into ``PIECES`` pieces by a hash of the ordering columns;
    pieces are counted, a running sum over those few counts gives where each
    begins, and rows are numbered inside their piece. Equal rows are
    interchangeable. The table must be a stored one: it is read twice.
    """
    pieces = table.withColumn("_piece", F.pmod(F.xxhash64(F.lit(7), *order), F.lit(PIECES)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = pieces.groupBy(shard, "_piece").agg(F.count(F.lit(1)).alias("_n")).select(
        shard, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy(shard, "_piece").orderBy(*order)
    # At most PIECES rows for each shard of the tree, however many rows the table has.
    return (
        pieces.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(begins), [shard, "_piece"])
        .withColumn(slot, (F.col("_begin") + F.col("_row")).cast("long"))
        .drop("_piece", "_row", "_begin")
    )


def shard_documents(docs: DataFrame, tree: Sequence[Place], larger: Sequence[Place] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is ``key``: doc_id and the tree decide. Size is the UTF-8 bytes of
    the text plus 16; a null text has no bytes and the checksum of no bytes.
    Rows with a null doc_id are one key. Repeated rows each get a slot. Other
    columns are not looked at. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    after = F.lit(None).cast("int") if larger is None else shard_of(F.col("doc_id"), larger)
    dealt = materialize(bare.select(
        "*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), tree).alias("shard"), after.alias("grown_shard"),
    ), "shards")
    return with_slots(dealt, "shard", ["doc_id", "text_crc32", "size"])
