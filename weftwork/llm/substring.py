"""Substring dedup over sliding spans of sentences and clauses.

A unit is a run of words that ends after a sentence or clause mark, at a line end, or after a long word (LONG letters or
more): such cuts depend on the words alone, so a passage is cut alike wherever it stands, also in the middle of a foreign
sentence. A span starts at every unit and takes the consecutive units up to the first that brings it to LEAST_WORDS words,
so short fixed lines never make one. Spans are compared by their words with a 128-bit hash over the whole corpus; the first
occurrence is the one with the smallest (id, place), and units covered by any other occurrence are removed.

A passage is found if whole units of it make a span: its first and last unit are lost where foreign words share them. Texts
without white space are one word and have no spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release
from .tokens import _MULT, _SPACE, Chunk, U, chunks, mix, powers, words

MARKS = ".!?,;:"
LEAST_WORDS, LONG = 35, 11
#: A span has LEAST_WORDS units at most, as each has a word.
_LENGTHS = 64
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in MARKS]] = True
_INVERSE = U(pow(int(_MULT), -1, 1 << 64))


class Units(NamedTuple):
    """Units of a chunk in order. at: first byte (a text's first unit begins where the text does); first, end: the words
    [first, end) of each; doc: its text; start: of each text, the place of its first unit, with one more entry at the end."""

    at: np.ndarray
    first: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    hashes: np.ndarray


def sentence_units(c: Chunk, long: int = LONG) -> Units:
    """The units of every text of a chunk; texts without words have none."""
    w = words(c, lower=False)
    n = len(w.starts)
    docs = len(c.rows)
    if not n:
        z = np.zeros(0, np.int64)
        return Units(z, z, z, z, np.zeros(docs + 1, np.int64), w.hashes)
    solid = ~_SPACE[c.data]
    count = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    after = np.append(w.starts[1:], len(c.data))  # where the next word begins
    after = np.minimum(after, c.at[w.doc + 1])
    stop = w.starts + count[after] - count[w.starts]  # a word's bytes stand together, so this is its end
    points = np.concatenate([[0], np.cumsum((c.data & 0xC0) != 0x80, dtype=np.int64)])
    lines = np.concatenate([[0], np.cumsum(c.data == 10, dtype=np.int64)])
    cut = _MARK[c.data[stop - 1]] | (lines[after] > lines[stop]) | (points[stop] - points[w.starts] >= long)
    cut[w.first[1:][np.diff(w.first) > 0] - 1] = True
    end = np.flatnonzero(cut) + 1
    first = np.concatenate([[0], end[:-1]])
    doc = w.doc[first]
    start = np.searchsorted(doc, np.arange(docs + 1))
    at = w.starts[first]
    has = np.flatnonzero(np.diff(start) > 0)
    at[start[has]] = c.at[has]
    return Units(at, first, end, doc, start, w.hashes)


def sentence_spans(c: Chunk, least_words: int = LEAST_WORDS, long: int = LONG) -> dict[str, np.ndarray]:
    """doc (in the chunk), place (of the first unit), length (in units), h1, h2 of every span."""
    u = sentence_units(c, long)
    last = np.searchsorted(u.end, u.first + least_words)
    ok = last < len(u.end)
    ok[ok] = u.doc[last[ok]] == u.doc[ok]
    i, j = np.flatnonzero(ok), last[ok]
    a, b = u.first[i], u.end[j]
    out = {"doc": u.doc[i], "place": i - u.start[u.doc[i]], "length": j - i + 1}
    n = len(u.hashes)
    back = powers(n + 1, _INVERSE)[a] if len(a) else np.zeros(0, np.uint64)
    for name, salt in (("h1", U(1)), ("h2", U(2))):
        total = np.zeros(n + 1, np.uint64)  # a polynomial in the words; moved to the span's own start it is the span's hash
        np.cumsum(mix(u.hashes + salt) * powers(n), out=total[1:])
        out[name] = mix((total[b] - total[a]) * back + (b - a).astype(np.uint64)).view(np.int64)
    return out


def _spans(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                r = sentence_spans(c, **options)
                ids = batch.column(0).take(pa.array(c.rows[r["doc"]]))
                yield pa.RecordBatch.from_arrays([pa.array(r["h1"]), pa.array(r["h2"]), ids, pa.array(r["place"] * _LENGTHS + r["length"])], names=["h1", "h2", "id", "at"])

    return run


def _without(long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                u = sentence_units(c, long)
                raw = c.data.tobytes()
                texts, counts, gone = [], [], []
                for k, row in enumerate(c.rows):
                    own = np.append(u.at[u.start[k] : u.start[k + 1]], c.at[k + 1])
                    drop = np.zeros(len(own) - 1, bool)
                    if (spans := batch.column(2)[int(row)].values) is not None:
                        for at in spans.to_numpy(zero_copy_only=False):
                            drop[at // _LENGTHS : at // _LENGTHS + at % _LENGTHS] = True
                    counts.append(len(drop))
                    gone.append(int(drop.sum()))
                    texts.append(b"".join(raw[own[i] : own[i + 1]] for i in np.flatnonzero(~drop)) if drop.any() else raw[c.at[k] : c.at[k + 1]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c.rows)), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], names=["id", "n_sentences", "n_removed", "text"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, gone): for each id with spans that are not the first of their kind, the places of those spans.

    One pass over the texts writes the spans; only those whose first hash occurs twice are looked at by both hashes. Counts
    are pre-aggregated and hot spans are joined, never gathered. A list holds at most one entry for each unit of a text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    spans = materialize(texts.mapInArrow(_spans(options), "h1 long, h2 long, id long, at long"), "spans")
    # Tables of their own, so that each join below is between two plain shuffles, whose hot keys adaptive execution splits.
    often = materialize(spans.groupBy("h1").agg(F.count("*").alias("c")).where("c > 1").select("h1"), "often")
    # The same kind of join at every size, so that what is moved grows in proportion.
    some = materialize(spans.join(often.hint("merge"), "h1", "left_semi"), "candidates")
    release(spans, often)
    first = some.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("id", "at")).alias("first")).where("c > 1")
    first = materialize(first.select("h1", "h2", F.col("first.id").alias("i0"), F.col("first.at").alias("a0")), "first")
    later = some.join(first.hint("merge"), ["h1", "h2"]).where("id <> i0 or at <> a0")
    gone = materialize(later.groupBy("id").agg(F.collect_set("at").alias("gone")), "gone")
    release(some, first)
    return gone


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_sentences, n_removed, text) for each row of `docs`: `text` is without the units of repeated spans, and the two
    counts are of units.

    Null texts come back empty; empty and blank texts have no units and come back as they are. Ids are taken to be unique:
    rows that repeat an id with one text count as one occurrence and lose the same places; with different texts each loses
    the places found for either. Rows with a null id come back whole. An empty table gives no rows; other columns are
    ignored, whatever their names. Options: least_words (at most 63), long.
    """
    if not 0 < options.get("least_words", LEAST_WORDS) < _LENGTHS:
        raise ValueError(f"least_words has to be 1 to {_LENGTHS - 1}")
    gone = repeated_spans(docs, id_col, text_col, **options)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = texts.join(gone.hint("merge"), "id", "left").select("id", "text", "gone")
    out = both.mapInArrow(_without(options.get("long", LONG)), "id long, n_sentences long, n_removed long, text string")
    return out.withColumnRenamed("id", id_col)
