"""Product codes against plain integer arithmetic."""

import hashlib
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from procurisk.llm import vector_codes


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [
        (i, label, [floor(Fraction(float(np.float32(c))) * 256) for c in x])
        for i, x, label in rows
        if x is not None and all(c is not None and isfinite(c) for c in x)
    ]
    width = -(-max(len(v) for _, _, v in kept) // parts)
    kept = [(i, label, v + [0] * (width * parts - len(v))) for i, label, v in kept]
    kept.sort(key=lambda row: (row[0] is None, row[0] or 0, row[2]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[vector[p] for vector in cut[:entries]] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(v[p], entry)), e) for e, entry in enumerate(books[p])) for p in range(parts)]
            for v in cut
        ]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, found) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(column) // len(mine) for column in zip(*mine)]
    found = assign()
    most = vector_codes.LARGEST
    errors = [sum(d for d, _ in a) for a in found]
    by_label = {}
    for (_, label, _), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + min(error, most)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(
        (
            (i, "".join(f"{e:02x}" for _, e in a), min(error, most), min(by_label[label], most))
            for (i, label, _), a, error in zip(kept, found, errors)
        ),
        key=str,
    ), digest


def table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return frame.select("*", *(F.lit("x").alias(c) for c in ("code", "error", "to_pivots", "position", "n")))


def got(spark, rows, **parameters):
    codes, books = vector_codes.encode(table(spark, rows), **parameters)
    return sorted((tuple(r) for r in codes.select("vec_id", "code", "error", "label_error").collect()), key=str), books.sha256()


def test_codes(spark):
    numbers = np.random.default_rng(3)
    rows = [(i, numbers.normal(0, 0.2, 32).astype(np.float32).tolist(), i % 3 or None) for i in range(300)]
    rows += [(500 + i, rows[7][1], 9) for i in range(100)] + [(7, rows[7][1], 1), (7, rows[8][1], 1), (None, rows[9][1], 2)]
    rows += [(-3, None, 1), (-2, [None] * 32, 1), (-1, [float("nan")] * 32, 1), (600, [float("-inf")] * 32, 1)]
    assert got(spark, rows) == brute(rows)


def test_awkward_vectors(spark):
    numbers = np.random.default_rng(4)
    rows = [(i, numbers.normal(0, 2, n).astype(np.float32).tolist(), 1) for i, n in enumerate([0, 1, 15, 16, 17, 33] * 4)]
    assert got(spark, rows) == brute(rows)
    rows = [(1, [], None), (2, [], 3)]
    assert got(spark, rows) == brute(rows)
    large = [(i, (numbers.normal(0, 1, 16) * 10.0 ** numbers.integers(-3, 38)).astype(np.float32).tolist(), i % 2) for i in range(120)]
    assert got(spark, large) == brute(large)
    codes, books = vector_codes.encode(table(spark, rows).limit(0))
    assert codes.count() == 0 and books is None and codes.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert got(spark, large[:20], parts=4, entries=3, rounds=5, pivots=2) == brute(large[:20], 4, 3, 5)
    with pytest.raises(ValueError):
        vector_codes.encode(table(spark, rows), entries=257)


def test_pivots_prune_without_changing_the_result():
    numbers = np.random.default_rng(5)
    centres = numbers.integers(-4000, 4000, (64, 4))
    part = centres[numbers.integers(0, 64, 5000)] + numbers.integers(-40, 40, (5000, 4))
    pivots = vector_codes.fitted(vector_codes.fixed_pivots(centres.tolist(), 4))
    to_pivots = vector_codes.roots(vector_codes.squares(part[:, None, :], pivots[None, :, :])).astype(np.float32)
    between = vector_codes.roots(vector_codes.squares(pivots[:, None, :], centres[None, :, :]))
    code, best, evaluated = vector_codes.nearest(part, centres, to_pivots, between)
    exact = vector_codes.squares(part[:, None, :], centres[None, :, :])
    assert (code == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert evaluated < 3 * len(part)  # of 64 each
