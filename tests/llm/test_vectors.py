"""Vector codes and whitening against plain computations."""

import hashlib
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from weftwork.llm import codes, queries, whitening

SF = "/root/testdata/sf0.001"
SPEC = "vec_id long, embedding array<float>, label int"
ODD = [(1, None, 1), (2, [1.0, None, 0.0, 1.0], 1), (3, [1.0, float("nan"), 0.0, 1.0], 1), (4, [1.0, float("inf"), 0.0, 1.0], 2), (5, [], 3), (6, [1.0], None)]


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.normal(size=width)], int(i) % 3 or None) for i in range(n)]


def brute_codes(rows, parts, entries, rounds, scale):
    """Codebooks and (id, code, error) by loops over Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[floor(scale * x) for x in v] for _, v, _ in rows]
    width = len(cut[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        far = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        moved = [list(b) for b in books]
        for p in range(parts):
            held = {}
            for v in cut:
                held.setdefault(nearest(p, part := v[p * width : (p + 1) * width])[0], []).append(part)
            for e, vs in held.items():
                moved[p][e] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
        books = moved
    out = []
    for (i, _, _), v in zip(rows, cut, strict=True):
        found = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    flat = ",".join(str(x) for b in books for c in b for x in c)
    return out, hashlib.sha256(flat.encode()).hexdigest()


def test_codes_equal_loops_and_ignore_partitions(spark):
    rows = vectors(60, 8, 1)
    rows += [(100, rows[0][1], 1)] * 30 + [(None, rows[1][1], None), (7, rows[2][1], 2)]  # ties, copies, a null and a repeated id
    want, books = brute_codes(rows, 2, 5, 3, 64)
    for n in (1, 7):
        got = codes.compress_vectors(spark.createDataFrame(rows, SPEC).repartition(n), parts=2, entries=5, rounds=3, scale=64).collect()
        assert sorted(map(str, want)) == sorted(str((r[0], r[1], r[2])) for r in got)
        assert {r.codebooks_sha256 for r in got} == {books}
        label = {r[0]: r[2] for r in rows if r[0] != 7}
        sums = {}
        for (_, _, lab), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), want, strict=True):
            sums[lab] = sums.get(lab, 0) + r[2]
        assert all(r.label_error == sums[label[r.vec_id]] for r in got if r.vec_id in label and r.vec_id is not None)


def test_codes_of_odd_rows(spark):
    rows = [*ODD, (7, [1.0, 2.0, 3.0, 4.0], None), (8, [1.0, 2.0, 3.0, 4.5], None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{SPEC}, id string, error int")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.compress_vectors(df).collect()}
    assert got == {5: (None, None, None), 6: (None, None, 0), 7: ("00000000", 0, 0), 8: ("00000001", 0, 0)}
    empty = spark.createDataFrame([], SPEC)
    assert codes.compress_vectors(empty).count() == 0
    assert codes.compress_vectors(spark.createDataFrame(ODD[:4], SPEC)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress_vectors(spark.createDataFrame([(1, [1.0, 2.0], 1)], SPEC))
    with pytest.raises(Exception, match="64-bit"):
        codes.compress_vectors(spark.createDataFrame([(1, [1e30, 2.0, 1.0, 1.0], 1)], SPEC)).collect()


def test_scatter_is_exact_and_whitening_whitens(spark):
    rows = vectors(400, 6, 2)
    rows += [(9, rows[3][1], 0)] * 50 + [(None, rows[4][1], 1)]
    df = spark.createDataFrame(rows, SPEC).repartition(5)
    x = [[floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    n, width = len(x), 6
    sums = [sum(v[j] for v in x) for j in range(width)]
    want = [[n * sum(v[i] * v[j] for v in x) - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    low, high = [min(v[j] for v in x) for j in range(width)], [max(v[j] for v in x) for j in range(width)]
    assert whitening.exact_scatter(df.select("embedding"), n, sums, low, high) == want
    out, fitted, off = whitening.whiten(df)
    assert (fitted.n, fitted.sums) == (n, sums) and off < 1e-9
    assert fitted.covariance[1, 2] == float(Fraction(want[1][2], n * n))
    got = out.collect()
    deviation = sorted(sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x)
    assert sorted(r.deviation for r in got) == deviation
    y = np.array([r.whitened for r in got])
    assert np.abs(y.T @ y / n - np.eye(width)).max() < 1e-9
    values = np.linalg.eigvalsh(np.cov(np.array(x, float).T, bias=True))[::-1]
    shares = sorted({(r.component, r.explained) for r in whitening.whitened_components(df).collect()})
    assert np.allclose([s for _, s in shares], values / values.sum(), rtol=1e-9)


def test_scatter_of_numbers_beyond_doubles(spark):
    """Sums of squares past 2^53, and n * x - sum past 2^31 squared, stay exact."""
    rows = [(i, [float(2**30 * (-1) ** i + 2 * i), float(i)], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, fitted, _ = whitening.whiten(df)
    x = [[floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows]
    sums = [sum(v[j] for v in x) for j in range(2)]
    exact = [40 * sum(v[i] * v[j] for v in x) - sums[i] * sums[j] for i in (0, 1) for j in (0, 1)]
    assert fitted.covariance.ravel().tolist() == [e / 1600 for e in exact]
    assert all(r.deviation is None for r in out.collect())  # past 64 bits


def test_whitening_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x") for r in [*ODD, (7, [1.0, 2.0, 3.0, 4.0], None), (8, [2.0, 2.0, 3.0, 4.5], None)]], f"{SPEC}, deviation string")
    got = whitening.whitened_components(df).collect()
    by = {(r.vec_id, r.component): r for r in got}
    assert {r.vec_id for r in got} == {5, 6, 7, 8} and len(got) == 16
    assert all(by[5, k].whitened is None and by[6, k].deviation is None for k in range(1, 5))
    assert by[7, 1].n == 2 and by[7, 1].whitened is not None and by[7, 1].identity_error < 1e-9
    assert by[7, 2].whitened is None and by[7, 2].explained == pytest.approx(0, abs=1e-12)  # two rows vary along one line
    assert whitening.whitened_components(spark.createDataFrame([], SPEC)).count() == 0
    same = whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 3, SPEC)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained is None and r.identity_error is None for r in same)


def test_op12_query(spark):
    got = queries.op12_whitening(spark, SF)
    assert got.count() == 500 * 32
    worst = got.agg({"identity_error": "max", "component": "max", "n": "max"}).first()
    assert worst["max(identity_error)"] < 1e-4 and worst["max(component)"] == 32 and worst["max(n)"] == 500


def test_primes_and_remainders():
    found = whitening.primes(1 << 90)
    assert len(found) == 5 and all(p < 1 << 20 and all(p % q for q in range(2, 1100)) for p in found)
    for x in (0, 1, -1, 1 << 80, -(1 << 80) - 7):
        assert whitening.chinese([x % p for p in found], found) == x
