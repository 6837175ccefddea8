"""Language identification by cross-parsing.

For each language a suffix automaton holds every substring of a bounded sample
of labelled text. A document is parsed against each of them into longest
matches: the walk goes on while the text read occurs in the sample, and where it
stops a new phrase begins. The more alike text and sample, the longer the
phrases and the fewer of them. Phrases are normalised to an entropy, phrases x
log2(sample length) / text length, and the least one wins.

Automata are complete tables (state, symbol) -> (next state, whether a phrase
ended), so many stretches of text are parsed in step with one another. Texts are
read whole, in stretches of ``STRETCH`` bytes; each stretch begins a phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.words import LOWER, slices, text_bytes
from surveyloom.plans.scratch import materialize

SAMPLE_ROWS = 24  # labelled rows of each language that the automata are made from
MOST_LANGUAGES = 64  # languages learned, those with the most labelled rows
SAMPLE_CHARS = 1000  # taken from each of them, at a place drawn by its hash
HELD_OUT = 2  # remainder of crc32(doc_id) by 4 that is never learned from
STRETCH = 256
UNKNOWN = "und"

# Digits, signs and white space tell no language apart: all of ASCII but letters reads as a space.
_SYMBOL = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in LOWER], dtype=np.uint8)


def remainder(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning; rows with a null id are."""
    return F.coalesce(remainder(doc_id) == HELD_OUT, F.lit(True))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, most: int = MOST_LANGUAGES) -> dict[str, list[str]]:
    """For each language a bounded number of pieces of its labelled texts, chosen by hash alone.

    Rows are dealt into ``rows`` places for each language and the least hash of
    each place wins, so tasks keep one number for a place and never a text. Of more
    than ``most`` languages those with the most labelled rows are learned, ties by name.
    """
    order, place = F.xxhash64(F.lit(11), "doc_id", "text"), F.pmod(F.xxhash64(F.lit(13), "doc_id", "text"), F.lit(rows))
    usable = docs.filter(~is_held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "doc_id", "text", order.alias("order"))
    places = materialize(usable.groupBy("lang", place.alias("place")).agg(F.min("order").alias("order"), F.count(F.lit(1)).alias("n")), "places")
    learned = places.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most).select("lang")
    least = places.join(learned, "lang").select("lang", "order").collect()
    # At most ``rows`` rows for each of ``most`` languages.
    chosen = docs.sparkSession.createDataFrame(least, "lang string, order long")
    start = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.greatest(F.char_length("text") - chars, F.lit(0)) + 1) + 1
    piece = F.col("text").substr(start.cast("int"), F.lit(chars))
    found = usable.join(F.broadcast(chosen), ["lang", "order"]).groupBy("lang", "order").agg(F.min(piece).alias("piece")).collect()
    pieces: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["order"])):
        pieces.setdefault(r["lang"], []).append(r["piece"])
    return pieces


@dataclass
class Automaton:
    """next[state * symbols + symbol] is twice the next state, plus one where a phrase ended."""

    symbols: np.ndarray  # class of each byte; 0 is padding
    width: int
    next: np.ndarray
    bits: float  # log2 of the sample's length


def build(text: bytes) -> Automaton:
    """The suffix automaton of ``text`` as a complete table."""
    coded = _SYMBOL[np.frombuffer(text, np.uint8)]
    present = np.unique(coded)
    symbols = np.full(256, len(present) + 1, np.int64)  # one class for every byte the sample lacks
    symbols[present] = np.arange(1, len(present) + 1)
    width = len(present) + 2
    length, link, step = [0], [-1], [{}]
    last = 0
    for c in symbols[coded].tolist():
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    # The last state is where a symbol that the sample lacks leads: such a symbol is a phrase of its own.
    states = len(length)
    table = np.empty((states + 1, width), np.int32)
    table[:] = 2 * states + 1
    table[0] = 2 * states  # the text begins there, so no phrase ends
    for c, q in step[0].items():
        table[1:, c] = 2 * q + 1
    for state, ways in enumerate(step):
        for c, q in ways.items():
            table[state, c] = 2 * q
    table[:, 0] = 2 * np.arange(states + 1)  # padding stays where it is
    return Automaton(_classes(symbols), width, table.ravel(), float(np.log2(max(len(coded), 2))))


def _classes(symbols: np.ndarray) -> np.ndarray:
    return symbols[_SYMBOL].astype(np.int32)


def phrases(automaton: Automaton, stretches: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Phrases of each row of a byte matrix (one column per stretch, padded beyond its length)."""
    state = np.zeros(stretches.shape[1], np.int32)
    ended = np.zeros(stretches.shape[1], np.int32)
    for at in range(stretches.shape[0]):
        open_ = int(np.searchsorted(-length, -at, side="left"))  # stretches come longest first
        symbol = automaton.symbols[stretches[at, :open_]]
        symbol += (state[:open_] >> 1) * automaton.width
        state[:open_] = automaton.next[symbol]
        ended[:open_] += state[:open_] & 1
    return ended + 1


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, automata = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                part, sizes = data[offsets[lo]:offsets[hi]], np.diff(offsets[lo:hi + 1])
                pieces = -(-sizes // STRETCH)
                owner = np.repeat(np.arange(hi - lo), pieces)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = (offsets[lo:hi] - offsets[lo])[owner] + nth * STRETCH
                length = np.minimum(STRETCH, sizes[owner] - nth * STRETCH)
                order = np.argsort(-length, kind="stable")
                owner, begin, length = owner[order], begin[order], length[order]
                padded = np.append(part, np.zeros(STRETCH, np.uint8))
                matrix = np.ascontiguousarray(padded[begin[None, :] + np.arange(STRETCH)[:, None]])
                cost = np.empty((len(names), hi - lo))
                for k, automaton in enumerate(automata):
                    total = np.bincount(owner, phrases(automaton, matrix, length), hi - lo) - np.maximum(pieces - 1, 0)
                    cost[k] = total * automaton.bits / np.maximum(sizes, 1)
                best = cost.argmin(axis=0) if len(names) else np.zeros(hi - lo, np.int64)
                if len(names) > 1:
                    ranked = np.partition(cost, 1, axis=0)
                    score = np.where(ranked[1] > 0, 1 - ranked[0] / np.maximum(ranked[1], 1e-300), 0.0)
                else:
                    score = np.full(hi - lo, float(len(names)))
                lettered = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool) & (len(names) > 0)
                picked = np.array([*names, UNKNOWN], dtype=object)[np.where(lettered, best, len(names))]
                rest = [c.slice(lo, hi - lo) for c in (batch.column(0), *batch.columns[3:])]
                yield pa.RecordBatch.from_arrays(
                    [rest[0], pa.array(picked, pa.string()), pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0)), *rest[1:]],
                    names=["doc_id", "lang_pred", "score", *batch.schema.names[3:]])
    return predict


def identify(docs: DataFrame, labelled: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score and the columns named in ``carry``.

    Learns from (doc_id, text, lang) of ``labelled``, by default ``docs``, leaving
    out held-out rows, at most ``MOST_LANGUAGES`` languages. lang_pred is a language learned, or ``und`` if the text is
    null or has no letter, or nothing could be learned. score is how much fewer
    normalised phrases the best language needs than the second, 0 to 1 (1 if only
    one was learned, 0 for ``und``); of equal languages the first by name wins.
    Predictions look at text alone.
    """
    spark = docs.sparkSession
    pieces = sample(docs if labelled is None else labelled)
    names = sorted(pieces)
    shared = spark.sparkContext.broadcast((names, [build(" ".join(pieces[n]).encode()) for n in names]))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered.alias("_letters"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = dict(docs.dtypes)
    extra = "".join(f", _c{i} {kinds[c]}" for i, c in enumerate(carry))
    found = rows.mapInArrow(_predict(shared), f"doc_id long, lang_pred string, score double{extra}")
    return found.select("doc_id", "lang_pred", "score", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)])
