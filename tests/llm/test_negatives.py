"""Hard negatives against a scan over all rows."""

import math

import numpy as np
import pytest

from threatloom.llm import negatives

ROW = "vec_id bigint, embedding array<float>, label int, anchor int, slot string, score int"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def expected(rows, every, positives, negatives_, low, scale=256):
    good = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for i, v, label in {(i, tuple(v), label) for i, v, label in good if i % every == 0}:
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in good if j != i]
        own = sorted((s, j) for s, j, other in scored if other == label)[:positives]
        rest = sorted((s, j) for s, j, other in scored if other != label)
        for p, j in own:
            window = [(s, k) for s, k in rest if low * -p <= 100 * -s <= 100 * -p][:negatives_]
            found += [(i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(window)]
    return sorted(found)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*row, 1, "x", 2) for row in rows], ROW).repartition(5)
    got = negatives.mine(frame, **options)
    assert got.columns == RESULT
    return sorted(tuple(row) for row in got.collect())


def test_windows_equal_a_scan(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((4, 6))
    rows = [
        (i, (centres[rng.integers(4)] + rng.standard_normal(6)).tolist(), 0 if rng.random() < 0.4 else int(rng.integers(1, 4)))
        for i in range(400)
    ]
    rows += rows[:40] + [rows[3]] * 30  # repeated rows, an anchor among them
    rows += [(1000 + i, rows[5][1], int(i % 3)) for i in range(60)]  # ties
    assert mined(spark, rows, every=10) == expected(rows, 10, 5, 5, 80)
    assert mined(spark, rows, every=50, positives=7, negatives=3, low_percent=50) == expected(rows, 50, 7, 3, 50)


def test_blocks_of_anchors_and_small_tiles_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist(), int(rng.integers(3))) for i in range(300)]
    whole = mined(spark, rows, every=3)
    monkeypatch.setattr(negatives, "BLOCK_VALUES", 60)
    assert mined(spark, rows, every=3) == whole == expected(rows, 3, 5, 5, 80)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (10, [1.0, 1.0], None), (20, None, 1), (30, [1.0, None], 1), (40, [nan, 1.0], 2),
        (50, [inf, 0.0], 1), (None, [1.0, 1.0], 1), (60, [], 1), (70, [1.0], 2), (80, [1.0, 0.9, 5.0], 2), (-10, [0.9, 0.9], 1),
        (1, [0.95, 0.95], 2), (2, [-1.0, -1.0], 2),
    ]
    assert mined(spark, rows, every=10) == expected(rows, 10, 5, 5, 80)
    assert mined(spark, [], every=10) == []
    assert mined(spark, [(5, [1.0], 1)], every=10) == []


def test_best_keeps_the_first_of_each_group_whatever_comes_between(monkeypatch):
    monkeypatch.setattr(negatives, "PENDING", 20)
    rng = np.random.default_rng(5)
    rows = [(int(g), int(s), int(i)) for g, s, i in zip(rng.integers(0, 4, 500), rng.integers(-9, 9, 500), rng.permutation(500))]
    best = negatives.Best(4, 3)
    for start in range(0, 500, 7):
        best.add(*(np.array(c) for c in zip(*rows[start : start + 7])))
    got = sorted(zip(*(c.tolist() for c in best.kept())))
    wanted = [r for g in range(4) for r in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))[:3]]
    assert got == sorted(wanted)


@pytest.mark.parametrize("size", [3, 2**20, 2**29, 2**40])
def test_products_are_exact_at_any_size(size):
    rng = np.random.default_rng(6)
    left, right = rng.integers(-size, size, (3, 5)), rng.integers(-size, size, (4, 4))
    got = negatives.products(left, right)
    for i in range(3):
        for j in range(4):
            exact = sum(int(a) * int(b) for a, b in zip(left[i], right[j]))
            assert got[i, j] == max(-negatives._MOST, min(negatives._MOST, exact))
