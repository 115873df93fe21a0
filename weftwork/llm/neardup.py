"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

Steps: (1) signature, set size and a 128-bit fingerprint of each text's shingle set; (2) equal sets collapse to the
smallest id; (3) the signature's bands are bucket keys; only representatives that share a bucket stay; (4) shingles that
no other such text has bound every intersection, so texts and pairs that can't reach the threshold leave, which is exact;
(5) in rounds, the members of each bucket are verified against a pivot, linked ones are joined by union-find, and buckets
whose members all carry one label are done; (6) texts of the buckets that are left are paired through their rarest
shingles: two sets over the threshold share one of these (prefix filtering, exact for all such texts), and pairs that
carry one label already are left out. No step gathers a bucket in one task, and none drops a pair that shares a bucket.
Joins on buckets and shingles are between plain shuffles of written tables, so that adaptive execution splits hot keys.

With 24 bands of 5 components a pair at a similarity of 0.85 is missed with a chance of (1 - 0.85^5)^24 < 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import fresh_names, materialize, release
from .tokens import U, chunks, mix, shingle_sets

BANDS, ROWS, PERCENT = 24, 5, 85
_STEP = 0x9E3779B97F4A7C15
_BATCH_ELEMENTS = 200_000


def step(k: int) -> np.uint64:
    """k times the stream constant, modulo 2^64."""
    return U(k * _STEP & 0xFFFFFFFFFFFFFFFF)


def super_minhash(elements: np.ndarray, owner: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (docs x m, uint64) of sets whose elements are given as 64-bit hashes with their owner.

    At level j an element sets one more component, k, of its own random permutation of the components to at most j + r.
    The correlated ranks lower the estimate's variance, and a set stops at the first level above its largest component.
    The high half of a component is its level, the low half its random part; sets without elements keep the maximum.
    """
    sig = np.full(docs * m, np.iinfo(np.uint64).max, np.uint64)
    order = None
    for j in range(m):
        drawn = mix(elements + step(j + 1))
        k = (((drawn & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64) + j
        if order is not None:
            at = np.arange(len(elements))
            moved = order[at, k]
            order[at, k] = order[:, j]
            order[:, j] = moved
            slot = moved.astype(np.int64)
        else:
            slot = k
        np.minimum.at(sig, owner * m + slot, (U(j) << U(32)) | (drawn >> U(32)))
        open_ = (sig.reshape(docs, m).max(axis=1) >> U(32)) > U(j)
        keep = open_[owner]
        if not keep.any():
            break
        if order is None:
            order = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (int(keep.sum()), 1))
            at, k = np.arange(len(order)), k[keep]
            order[at, k], order[:, 0] = 0, k
            elements, owner = elements[keep], owner[keep]
        elif not keep.all():
            elements, owner, order = elements[keep], owner[keep], order[keep]
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` components; bands never share keys."""
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to((np.arange(bands, dtype=np.uint64) + U(1)) * U(_STEP), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key * U(_STEP) + parts[:, :, r])
    return key


def _signatures(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                group: list[tuple[int, np.ndarray]] = []
                held = 0
                for row, own in shingle_sets(c, size):
                    group.append((row, own))
                    held += len(own)
                    if held >= _BATCH_ELEMENTS:
                        yield out(batch, group)
                        group, held = [], 0
                if group:
                    yield out(batch, group)

    def out(batch: pa.RecordBatch, group: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(s) for _, s in group], np.int64)
        elements = np.concatenate([s for _, s in group])
        owner = np.repeat(np.arange(len(group)), sizes)
        keys = band_keys(super_minhash(elements, owner, len(group), bands * rows), bands, rows)
        prints = []
        for salt in (1, 2):
            total = np.zeros(len(elements) + 1, np.uint64)
            np.cumsum(mix(elements + step(salt)), out=total[1:])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            prints.append(mix(total[ends[1:]] - total[ends[:-1]] + sizes.astype(np.uint64)).view(np.int64))
        flat = pa.array(keys.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32) * bands), flat)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in group])), pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), lists], names=["id", "n", "p1", "p2", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                found = list(shingle_sets(c, size))
                ends = np.concatenate([[0], np.cumsum([len(s) for _, s in found])]).astype(np.int32)
                flat = np.concatenate([s for _, s in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in found])), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "items"])

    return run


def _fits(percent: int) -> Column:
    """Sizes and shared items alone allow the threshold: i * 100 >= (n + nb - i) * percent for the largest i possible."""
    most = F.least("n", "nb", "s", "sb")
    return most * (100 + percent) >= (F.col("n") + F.col("nb")) * percent


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.size("ia") + F.size("ib") - both) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, size: int = 5, pivot_rounds: int = 3) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each distinct id of `docs`.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; a set holds the distinct runs of `size`
    words, or the whole sequence where there are fewer. Null, empty and blank texts have no shingles and link with nothing.
    Rows with a null id are left out. Rows that repeat an id with the same text count once; ids are otherwise taken to be
    unique (one that repeats with different texts gets one row, with the largest size and smallest component found).
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    sigs = materialize(texts.mapInArrow(_signatures(bands, rows, size), "id long, n long, p1 long, p2 long, bands array<long>"), "signatures")
    reps = materialize(sigs.where("n > 0").groupBy("p1", "p2", "n").agg(F.min("id").alias("rep")), "sets")

    firsts = sigs.join(reps.select(F.col("rep").alias("id"), "p1", "p2", "n").hint("merge"), ["id", "p1", "p2", "n"], "left_semi")
    spread = materialize(firsts.select("id", "n", F.explode("bands").alias("bucket")), "bands")
    members = in_shared_buckets(spread.dropDuplicates(["bucket", "id"]))
    release(spread)

    wanted = members.select("id").distinct()
    # The same join at every size, so that the texts that it moves grow in proportion.
    sets = materialize(texts.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(_sets(size), "id long, items array<long>").dropDuplicates(["id"]), "items")
    alone = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    # s: how many of a set's items some other candidate has, so that no intersection is larger.
    bound = members.join(alone, "id", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    bound = materialize(bound.where(F.col("s") * 100 >= F.col("n") * percent), "buckets")
    release(members)
    members = in_shared_buckets(bound)
    release(bound)

    edges: list[DataFrame] = []
    labels: DataFrame | None = None
    for turn in range(pivot_rounds + 1):
        if members.isEmpty():
            break
        live = members.withColumn("label", F.col("id"))
        if labels is not None:
            live = unresolved(members, labels)
            release(members)
            members = live.drop("label")
            members._scratch = live._scratch
            if live.isEmpty():
                break
        if turn < pivot_rounds:
            pairs = pivot_pairs(live, turn, percent)
        else:
            left = materialize(live.select("id", "n", "s", "label").distinct(), "left")
            pairs = rare_item_pairs(left, sets, percent)
            release(left)
        edges.append(materialize(verify(pairs, sets, percent), "links"))
        release(pairs, labels)
        every = edges[0]
        for e in edges[1:]:
            every = every.union(e)
        labels = connected_components(every)
    release(members, sets, *edges)

    root = reps.withColumnRenamed("rep", "node")
    if labels is not None:
        root = root.join(labels, "node", "left")
    else:
        root = root.withColumn("component", F.col("node"))
    root = materialize(root.select("p1", "p2", "n", F.coalesce("component", "node").alias("component")), "roots")
    release(reps, labels)
    out = sigs.select("id", "n", "p1", "p2").join(root.hint("merge"), ["p1", "p2", "n"], "left")
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    out = materialize(out.groupBy(id_col).agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id")), "groups")
    release(sigs, root)
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def in_shared_buckets(members: DataFrame) -> DataFrame:
    """The rows of buckets that have two members or more, written."""
    shared = materialize(members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "shared")
    out = materialize(members.join(shared.hint("merge"), "bucket", "left_semi").select("bucket", *[c for c in members.columns if c != "bucket"]), "buckets")
    release(shared)
    return out


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their labels, of buckets in which labels differ, written."""
    live = members.join(labels.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left")
    live = materialize(live.withColumn("label", F.coalesce("component", "id")).drop("component"), "labelled")
    mixed = materialize(live.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "mixed")
    out = materialize(live.join(mixed.hint("merge"), "bucket", "left_semi"), "unresolved")
    release(live, mixed)
    return out


def pivot_pairs(live: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each member with a pivot of its bucket that has another label, written.

    The first pivot is the bucket's smallest id; later ones lead salted parts of it, so that they vary.
    """
    salted = live.withColumn("part", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 if turn == 0 else 8 ** (turn % 3))))
    pivots = salted.groupBy("bucket", "part").agg(F.min(F.struct("id", "n", "s", "label")).alias("p"))
    pivots = materialize(pivots.select("bucket", "part", F.col("p.id").alias("b"), F.col("p.n").alias("nb"), F.col("p.s").alias("sb"), F.col("p.label").alias("lb")), "pivots")
    near = salted.join(pivots.hint("merge"), ["bucket", "part"]).where((F.col("label") != F.col("lb")) & (F.col("id") != F.col("b")) & _fits(percent))
    out = materialize(near.select(F.col("id").alias("a"), "b").distinct(), "pairs")
    release(pivots)
    return out


def rare_item_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of `left` (id, n, s, label) with different labels that may reach the threshold, written.

    The items of a set are ordered by how many of the sets have them, rarest first. Of two sets over the threshold t, the
    first n - ceil(t n) + 1 items of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller share an item,
    and behind their first common item enough items have to be left. Per item, rows of its most frequent label only meet
    rows of other labels, so a large group that is linked already is not paired with itself.
    """
    of = sets.join(left.hint("merge"), "id").select("id", "n", "s", "label", F.explode("items").alias("item"))
    of = materialize(of, "left-items")
    often = materialize(of.groupBy("item").agg(F.count("*").alias("f")).where("f > 1"), "frequent")
    # A set's own items, in order: a list of the size of one text's set.
    ranked = of.join(often.hint("merge"), "item", "left").groupBy("id").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "item"))).alias("items"))
    t = f"(n * {percent} + 99) div 100"
    u = f"(n * {2 * percent} + {99 + percent}) div {100 + percent}"
    head = ranked.select("id", "n", "s", "label", F.expr(f"n - {u} + 1").alias("small"), F.posexplode(F.expr(f"slice(items, 1, cast(n - {t} + 1 as int))")).alias("at", "x"))
    head = materialize(head.where("x.f > 1").select(F.col("x.item").alias("item"), "id", "n", "s", "label", "at", (F.col("at") < F.col("small")).alias("early")), "prefixes")
    release(of, often)
    tops = head.groupBy("item", "label").agg(F.count("*").alias("c")).groupBy("item").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
    tops = materialize(tops.where("labels > 1").select("item", F.col("top.label").alias("top")), "tops")
    rows = materialize(head.join(tops.hint("merge"), "item"), "meeting")
    few = rows.where("label <> top").select("item", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"), F.col("label").alias("lb"), F.col("at").alias("atb"), F.col("early").alias("earlyb"))
    near = few.hint("merge").join(rows, "item").where((F.col("label") != F.col("lb")) & (F.col("label").eqNullSafe(F.col("top")) | (F.col("id") < F.col("b"))))
    smaller = F.col("early") & ((F.col("n") < F.col("nb")) | (F.col("n") == F.col("nb"))) | F.col("earlyb") & (F.col("n") >= F.col("nb"))
    rest = F.least(F.col("n") - F.col("at"), F.col("nb") - F.col("atb"))
    near = near.where(smaller & (rest * (100 + percent) >= (F.col("n") + F.col("nb")) * percent) & _fits(percent))
    out = materialize(near.select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct(), "pairs")
    release(head, tops, rows)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the documents whose group has a smaller id.

    Of rows that repeat an id with the same text one stays, the first in the order of the other columns; rows that repeat
    an id with different texts stay or go together. Rows with a null id stay, as nothing links them. Columns may have any
    names; an empty table stays empty.
    """
    key, place, gone_id = fresh_names(docs, "weft_key", "weft_place", "weft_gone")
    verdict = near_duplicates(docs, id_col, text_col, **options)
    gone = verdict.where(~F.col("kept")).select(F.col(id_col).alias(gone_id))
    named = docs.withColumn(key, F.col(id_col).cast("long"))
    # The same join at every size: texts are moved once, in proportion. The window has the join's own partitioning.
    left = named.where(F.col(key).isNotNull()).join(gone.hint("merge"), F.col(key) == F.col(gone_id), "left_anti")
    order = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col) and f.dataType.typeName() not in ("map", "variant")]
    one = Window.partitionBy(key, text_col).orderBy(*order or [F.lit(0)])
    left = left.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return left.drop(key, place).unionByName(docs.where(F.col(id_col).cast("long").isNull()))
