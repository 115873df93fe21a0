"""Quality rules and a hashed n-gram logistic regression, trained on labelled rows and scored in Arrow batches.

Features are word unigrams and bigrams and character trigrams and pentagrams (over A-Z as a-z and 0-9 as 0) of the whole
text, hashed to 2^16 columns with a sign; each group of n-grams has its counts damped (sign(c) * log(1 + |c|)) and scaled
to unit length, so that long texts weigh no more than short ones. The model is fitted on a sample of labelled rows of
bounded size in rows and bytes, chosen by a hash of the id; a third of it is held out for calibration by Platt's method. A document is
rejected where its calibrated probability of low quality is above a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, release
from .tokens import _LOWER, _SPACE, U, Chunk, chunks, mix, run_hashes, windows, words

DIMENSIONS = 1 << 16
#: Most labelled rows of each class that the model is fitted on, and most feature entries that these may have together.
SAMPLE_A_CLASS, ENTRIES_A_CLASS = 1500, 12_000_000
#: The lowest calibrated probability of low quality that rejects.
REJECT_ABOVE = 0.7
LEAST_WORDS = 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_FOLD = _LOWER.copy()
_FOLD[48:58] = 48


def base_counts(c: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a chunk."""
    w = words(c, lower=False)
    docs, data = len(c.rows), c.data

    def by_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[c.at[1:]] - total[c.at[:-1]]

    out = {"n_words": np.diff(w.first).astype(np.int64), "word_chars": by_doc(~_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": by_doc(_SYMBOLS[data])}
    # Lines: cut at \n and at the ends of texts; those with a word count where an equal one stands before them.
    breaks = data == 10
    starts = np.unique(np.concatenate([c.at[:-1], np.flatnonzero(breaks) + 1]))
    starts = starts[starts < len(data)]
    dup = np.zeros(docs, np.int64)
    if len(starts):
        doc = np.searchsorted(c.at, starts, "right") - 1
        size = np.diff(np.append(starts, len(data)))
        ends = np.concatenate([[0], np.cumsum(~_SPACE[data])])
        full = (ends[np.append(starts[1:], len(data))] - ends[starts]) > 0
        has_break = breaks[np.append(starts[1:], len(data)) - 1]
        key = mix(run_hashes(data, starts, ~breaks) + (size - has_break).astype(np.uint64) * U(0x9E3779B97F4A7C15)) + mix(doc.astype(np.uint64) + U(1))
        _, first = np.unique(key[full], return_index=True)
        repeat = np.ones(int(full.sum()), bool)
        repeat[first] = False
        dup = np.bincount(doc[full][repeat], minlength=docs)
    out["n_dup_lines"] = dup.astype(np.int64)
    hashes, at = windows(w, 3)
    covered = np.zeros(len(w.hashes) + 3, np.int64)
    if len(at):
        key = mix(hashes + mix(w.doc[at].astype(np.uint64) + U(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + 3, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[: len(w.hashes)] > 0)])
    out["n_repeat_words"] = inside[w.first[1:]] - inside[w.first[:-1]]
    return out


def _grams(c: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of the n-grams of each group."""
    w = words(c, lower=True)
    out = [(w.hashes, w.doc)]
    pair, at = windows(w, 2)
    out.append((pair, w.doc[at]))
    data = _FOLD[c.data].astype(np.uint64)
    doc = np.repeat(np.arange(len(c.rows)), np.diff(c.at))
    for n in (3, 5):
        m = len(data) - n + 1
        if m <= 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        h = np.zeros(m, np.uint64)
        for t in range(n):
            h = (h << U(8)) | data[t : t + m]
        keep = doc[:m] == doc[n - 1 :]
        out.append((mix(h[keep] + U(n)), doc[:m][keep]))
    return out


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, column, value) of the non-zero features of each text of a chunk, by text and column."""
    docs, columns, values = [], [], []
    for g, (h, doc) in enumerate(_grams(c)):
        if not len(h):
            continue
        h = mix(h + U(g * 7919 + 1))
        column = (h & U(DIMENSIONS - 1)).astype(np.int64)
        sign = np.where(h >> U(63), 1.0, -1.0)
        key, place = np.unique(doc * DIMENSIONS + column, return_inverse=True)
        total = np.bincount(place, sign)
        owner = key // DIMENSIONS
        damped = np.sign(total) * np.log1p(np.abs(total))
        norm = np.sqrt(np.bincount(owner, damped**2, minlength=len(c.rows)))
        docs.append(owner)
        columns.append(key % DIMENSIONS)
        values.append(damped / np.maximum(norm[owner], 1e-12))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(docs), np.concatenate(columns), np.concatenate(values)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, c: Chunk) -> np.ndarray:
        """Calibrated probability of low quality of each text of a chunk."""
        doc, column, value = features(c)
        z = np.bincount(doc, self.weights[column] * value, minlength=len(c.rows)) + self.bias
        return _sigmoid(self.slope * z + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], low: np.ndarray, held: np.ndarray, rounds: int = 200, rate: float = 2.0, l2: float = 1e-4, block: int = 1 << 19) -> Model:
    """Full-batch logistic regression with classes of equal weight, then Platt calibration on the held-out rows.

    `rows` holds (columns, values) of each row, and is emptied: entries are packed into blocks of about `block`, so that the
    working arrays of a round stay small. Classes of which either part holds none give a model that rejects nothing.
    """
    train = ~held
    if min(int((low & train).sum()), int((~low & train).sum())) == 0:
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, -40.0)
    n, packs, i = len(rows), [], 0
    while i < n:
        j, held_entries = i, 0
        while j < n and (j == i or held_entries + len(rows[j][0]) <= block):
            held_entries += len(rows[j][0])
            j += 1
        owner = np.repeat(np.arange(j - i, dtype=np.int32), [len(c) for c, _ in rows[i:j]])
        packs.append((i, j, owner, np.concatenate([c for c, _ in rows[i:j]]).astype(np.uint16), np.concatenate([v for _, v in rows[i:j]]).astype(np.float32)))
        rows[i:j] = [(np.zeros(0), np.zeros(0))] * (j - i)
        i = j

    def scores(w: np.ndarray, b: float) -> np.ndarray:
        return np.concatenate([np.bincount(owner, w[column] * value, minlength=j - i) for i, j, owner, column, value in packs]) + b

    weight = np.where(low, 0.5 / max(1, (low & train).sum()), 0.5 / max(1, (~low & train).sum())) * train
    w, b, speed, pull = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0
    for _ in range(rounds):
        error = (_sigmoid(scores(w, b)) - low) * weight
        slope = l2 * w
        for i, j, owner, column, value in packs:
            slope += np.bincount(column, error[i:j][owner] * value, minlength=DIMENSIONS)
        speed = 0.9 * speed - rate * slope
        pull = 0.9 * pull - rate * error.sum()
        w, b = w + speed, b + pull
    z = scores(w, b)
    part = held if min((low & held).sum(), (~low & held).sum()) > 0 else train
    n1, n0 = (low & part).sum(), (~low & part).sum()
    goal = np.where(low, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))[part]
    share = np.where(low, 0.5 / n1, 0.5 / n0)[part]
    slope, shift, x = 1.0, 0.0, z[part]
    for _ in range(50):  # Newton steps on two parameters
        p = _sigmoid(slope * x + shift)
        e, v = (p - goal) * share, np.maximum(p * (1 - p), 1e-9) * share
        grad = np.array([(e * x).sum(), e.sum()]) + 1e-3 * np.array([slope - 1, shift])
        hess = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-3 * np.eye(2)
        slope, shift = np.array([slope, shift]) - np.linalg.solve(hess, grad)
    return Model(w.astype(np.float32), float(b), float(slope), float(shift))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(2)):
            doc, column, value = features(c)
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(len(c.rows) + 1)).astype(np.int32)
            take = pa.array(c.rows)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (column[order].astype(np.int32), value[order].astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in (0, 1, 3)), pa.array(np.diff(ends)), *lists], names=["id", "low", "print", "n", "columns", "values"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the rows (id, low, columns, values), in the order of their ids; none without rows."""
    got = {}
    for batch in batches:
        low = batch.column(1).to_pylist()
        for i, k in enumerate(batch.column(0).to_pylist()):
            got[k] = (low[i], batch.column(2)[i].values.to_numpy().astype(np.uint16), batch.column(3)[i].values.to_numpy().copy())
    ids = sorted(got)
    if not ids:
        return
    held = mix(np.array(ids, np.int64).view(np.uint64)) % U(3) == 0
    low = np.array([got[k][0] for k in ids])
    batch = None
    m = fit([got.pop(k)[1:] for k in ids], low, held)
    yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in m[1:])], names=["weights", "bias", "slope", "shift"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_A_CLASS, entries: int = ENTRIES_A_CLASS) -> Model:
    """Fit on at most `sample` labelled rows of each class, those with the smallest hashes of their ids, as far as they have
    `entries` feature entries together (12 bytes each in the task that fits while they arrive, 10 in the fit).

    A label of 0 is low quality; of labels that repeat an id the lowest counts, and of documents that repeat one the one
    whose text has the smallest hash. Null labels and labelled ids without a document are ignored. The sample's features
    meet in one task of an executor; the model, 256 KB, is all that comes to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.min(label_col) == 0).alias("low"))
    picked = None
    for low in (True, False):
        part = known.where(F.col("low") == low).orderBy(F.xxhash64("id", F.lit(11)), "id").limit(sample)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Broadcast: at most 2 * sample ids.
    rows = texts.join(F.broadcast(picked), "id").select("id", "low", "text", F.xxhash64("text").alias("print"))
    rows = materialize(rows.mapInArrow(_featurize, "id long, low boolean, print long, n int, columns array<int>, values array<float>"), "features")
    sizes = rows.groupBy("id", "low").agg(F.min(F.struct("print", "n")).alias("one"))  # at most 2 * sample rows from here on
    upto = F.sum("one.n").over(Window.partitionBy("low").orderBy(F.xxhash64("id", F.lit(11)), "id"))
    wanted = sizes.withColumn("upto", upto).where(F.col("upto") <= entries).select("id", F.col("one.print").alias("print"))
    # Equal rows of one id have equal features; one task gets the sample, and the driver gets the model alone.
    sampled = rows.join(F.broadcast(wanted), ["id", "print"]).select("id", "low", "columns", "values").dropDuplicates(["id"]).repartition(1)
    made = sampled.mapInArrow(_fitted, "weights binary, bias double, slope double, shift double").first()
    release(rows)
    if made is None:
        return Model(np.zeros(DIMENSIONS, np.float32), 0.0, 0.0, -40.0)
    return Model(np.frombuffer(made.weights, np.float32), made.bias, made.slope, made.shift)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", reject_above: float = REJECT_ABOVE, sample: int = SAMPLE_A_CLASS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, low_quality) for each row.

    Null texts have no words. `base_failed`: under 50 words, or over half of them inside 3-word runs that occur twice or
    more. `kept` is false where that holds or `low_quality`, the calibrated probability, is above `reject_above`; one that is
    equal to it is kept. Texts of any length are read whole, some half a megabyte of short ones or one long one at a time.
    Repeated rows and null ids stay; other columns are ignored; an empty table gives no rows; without labels of both classes
    only the base rules reject.
    """
    # Broadcast: the weights, 256 KB whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for c in chunks(batch.column(1)):
                n = base_counts(c)
                low = model.probability(c)
                failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > 50 * n["n_words"])
                columns = [batch.column(0).take(pa.array(c.rows)), *(pa.array(n[k]) for k in _COUNTS), pa.array(failed), pa.array(~failed & (low <= reject_above)), pa.array(low)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *_COUNTS, "base_failed", "kept", "low_quality"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spec = "id long, " + ", ".join(f"{k} long" for k in _COUNTS) + ", base_failed boolean, kept boolean, low_quality double"
    return rows.mapInArrow(run, spec).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that pass; as the verdict depends on the text alone, rows are judged in place, without a join.

    Null, empty and blank texts have no words and go; repeated rows and rows with a null id are judged like all others; every
    column stays as it is, whatever its name; an empty table stays empty. Without labels of both classes only the base
    rules reject.
    """
    reject = options.pop("reject_above", REJECT_ABOVE)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for c in chunks(batch.column(text_col)):
                n = base_counts(c)
                keep[c.rows] = (n["n_words"] >= LEAST_WORDS) & (100 * n["n_repeat_words"] <= 50 * n["n_words"]) & (model.probability(c) <= reject)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
