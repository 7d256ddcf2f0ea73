"""Operators on embeddings: whitening (11), vector codes (12)."""

import hashlib
from collections import defaultdict

import edge_cases
import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

from gridwork.llm import vector_codes, whitening
from gridwork.llm.queries import QUERIES

INF, NAN = float("inf"), float("nan")


def _embeddings(spark, rows):
    df = spark.createDataFrame([(i, v, n) for i, v, n in rows], "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("x", "size", "n", "chunk", "error", "of", "salt", "component", "part")])


def _odd_rows(width=32, n=90):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=width).tolist(), int(i % 3) if i % 7 else None) for i in range(n)]
    rows += [(5, rows[5][1], rows[5][2]), (None, rows[6][1], None), (1000, rows[6][1], 1), (1001, [0.0] * width, 2)]
    return rows + [(2000, None, 1), (2001, [NAN] + [0.0] * (width - 1), 1), (2002, [INF] + [0.0] * (width - 1), 1),
                   (2003, [None] + [0.0] * (width - 1), 1)]


def _finite(rows):
    return [(i, v, n) for i, v, n in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def _whole(v):
    return [int(np.floor(256 * float(np.float32(c)))) for c in v]


def _check_whitened(rows, given):
    """Against the eigenvectors of numpy's solver."""
    x = np.array([_whole(v) for _, v, _ in given])
    unique = np.unique(x, axis=0)
    n, sums = len(unique), unique.sum(axis=0)
    centred = unique - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    by_row = defaultdict(list)
    for r in rows:
        assert r["n"] == n and r["identity_error"] <= 1e-4
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
        by_row[r["vec_id"], r["deviation"]].append((r["component"], r["whitened"]))
    columns = np.array([(v - sums / n) @ vectors[:, :4] / np.sqrt(values[:4]) for v in x])
    signs = None
    for (i, _, _), own, v in zip(given, columns, x, strict=True):
        found = sorted(by_row[i, int(((n * v - sums) ** 2).sum())])
        got = np.array([w for _, w in found]).reshape(4, -1)[:, 0]
        signs = np.sign(got * own) if signs is None else signs
        assert np.allclose(got, own * signs, atol=1e-9)
    return sum(map(len, by_row.values()))


def test_whitened_as_by_numpy(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{parity.SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op11_whitened_vectors"](spark, parity.SMALL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert _check_whitened(got.collect(), _finite(given)) == 4 * len(_finite(given))
    assert edge_cases.empty(spark, got).schema == got.schema


def test_whitening_edges(spark):
    rows = _odd_rows()
    got = whitening.whiten(_embeddings(spark, rows)).collect()
    assert _check_whitened(got, _finite(rows)) == 4 * len(_finite(rows))
    assert sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 5 for r in got) == 8
    first = {r["component"]: r["whitened"] for r in got if r["vec_id"] == 1000}
    assert first == {r["component"]: r["whitened"] for r in got if r["vec_id"] is None}
    empty = _embeddings(spark, rows[:1]).limit(0)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(_embeddings(spark, [(1, [0.5] * 8, 0)] * 3)).count() == 0  # one distinct vector: no spread
    two = whitening.whiten(_embeddings(spark, [(1, [0.0] * 8, 0), (2, [1.0] * 8, 0), (3, [], 0)])).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0)]
    huge = whitening.whiten(_embeddings(spark, [(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 7.0], 0)])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 3} == {None} and len(huge) >= 3
    both = whitening.whiten(_embeddings(spark, rows + [(i, [float(i % 3), float(i % 5)], 0) for i in range(30)])).collect()
    assert {r["n"] for r in both} == {len({tuple(_whole(v)) for _, v, _ in _finite(rows)}), 15}


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 1, 0], [2, 2 - 1e-9, 1, 1, 1e-3, 0], [1] * 6, [7, 0, 0, 0, 0, 0],
                                    [-1, 4, -3, 2, 0, 9]])
def test_slices_and_iteration(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))
    matrix = (q * np.array(values)) @ q.T
    matrix = (matrix + matrix.T) / 2
    for shift in (-2, 0.25, 1.5, 2.5, 3.5, 8):
        assert whitening.above(matrix, shift) == sum(v > shift for v in values)
    found, vectors = whitening.leading(matrix, 4, 1e-9)
    wanted = [v for v in sorted(values, reverse=True) if v > 1e-9][:4]
    assert np.allclose(found, wanted, atol=1e-10) and vectors.shape == (6, len(wanted))
    assert np.allclose(vectors.T @ vectors, np.eye(len(wanted)), atol=1e-10)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-9)


def test_inertia_of_matrices_without_diagonal():
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0, 1)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3, 0)
    rng = np.random.default_rng(8)
    for _ in range(20):
        a = rng.normal(size=(9, 9))
        a = a + a.T
        np.fill_diagonal(a, 0)
        values = np.linalg.eigvalsh(a)
        assert whitening.inertia(a) == ((values < 0).sum(), 0, (values > 0).sum())


def _codes_by_hand(given):
    """The contract, step by step, in Python's numbers."""
    rows = [(i, n, _whole(v)) for i, v, n in given]
    width = -(-len(rows[0][2]) // 16)
    rows = [(i, n, [(x + [0] * (16 * width - len(x)))[p * width:(p + 1) * width] for p in range(16)]) for i, n, x in rows]
    start = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, sum(r[2], [])))[:64]
    books = [[r[2][p] for r in start] for p in range(16)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            own = defaultdict(list)
            for r in rows:
                own[near(r[2][p], books[p])[1]].append(r[2][p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, totals = [], defaultdict(int)
    for i, n, parts in rows:
        found = [near(v, b) for v, b in zip(parts, books, strict=True)]
        out.append((i, n, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        totals[n] += out[-1][3]
    return sorted(((i, code, error, totals[n], digest) for i, n, code, error in out), key=repr)


def test_vector_codes_match_sql(spark):
    assert parity.check(spark, "op12_vector_codes")


@pytest.mark.parametrize("width", [32, 64, 20])
def test_vector_codes_by_hand(spark, width):
    rows = _odd_rows(width, 150)
    got = vector_codes.encode(_embeddings(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == _codes_by_hand(_finite(rows))


def test_vector_codes_edges(spark):
    assert vector_codes.encode(_embeddings(spark, _odd_rows()[:1]).limit(0)).count() == 0
    few = [(1, [0.25] * 16, 1), (1, [0.5] * 16, 1), (None, [0.5] * 16, None)]
    assert sorted(map(tuple, vector_codes.encode(_embeddings(spark, few)).collect()), key=repr) == _codes_by_hand(few)
    mixed = vector_codes.encode(_embeddings(spark, [*few, (3, [], 1), (4, [1.0], 2)])).collect()
    assert len(mixed) == 5 and len({r["codebooks_sha256"] for r in mixed}) == 3
    huge = [(i, [3e38 if i % 2 else -3e38] * 16, 0) for i in range(2)] + [(i, [1e6 * i] * 16, 1) for i in range(2, 80)]
    got = {r["vec_id"]: r for r in vector_codes.encode(_embeddings(spark, huge)).collect()}
    assert got[2]["error"] is not None and len(got) == 80


def test_vector_codes_with_many_labels(spark, monkeypatch):
    rows = [(i, v, k % 50 if k % 3 else 1) for k, (i, v, _) in enumerate(_finite(_odd_rows()))]
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 3)
    got = vector_codes.encode(_embeddings(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == _codes_by_hand(rows)


@pytest.mark.parametrize("points", [
    np.zeros((100, 4), int), np.arange(400).reshape(100, 4), np.random.default_rng(1).integers(-3, 4, (3000, 4)),
    np.random.default_rng(2).normal(scale=90, size=(5000, 4)).astype(int), np.random.default_rng(3).integers(-2, 2, (500, 1)) * 2 ** 40,
    np.zeros((40, 0), int)])
def test_trees_assign_as_brute_force(points):
    points = points.astype(np.int64)
    tree = vector_codes.build(points)
    assert sorted(tree.order) == list(range(len(points)))
    for ball in range(len(tree.start)):
        own = points[tree.order[tree.start[ball]:tree.end[ball]]]
        assert (np.sqrt(((own - tree.centre[ball]) ** 2).sum(axis=1)) <= tree.radius[ball] * (1 + 1e-9) + 1e-9).all()
        total = [(int(h) << vector_codes.HALF) + int(w) for h, w in zip(tree.high[ball], tree.low[ball], strict=True)]
        assert total == [sum(map(int, c)) for c in own.T]
    entries = np.concatenate([points[:40], points[:40] + 1, points[:1]])
    found = vector_codes.assign(tree, points, entries)
    got = vector_codes._entry_of(tree, found)
    exact = points.astype(object)
    for i in np.random.default_rng(4).choice(len(points), 40):
        wanted = min((sum((a - int(b)) ** 2 for a, b in zip(exact[i], e, strict=True)), k) for k, e in enumerate(entries))[1]
        assert got[i] == wanted
