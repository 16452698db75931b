import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threatloom.operators import neighbours as N


def brute(x, ids, k):
    distances = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    distances[ids[:, None] == ids[None]] = np.inf
    return np.sort(distances, axis=1)[:, :k]


@pytest.mark.parametrize("scale", [1.0, 1e-3])
def test_blocks_give_the_distances_of_a_plain_comparison(monkeypatch, scale):
    """Far from the origin products lose the digits that tell close rows apart; ids come twice, rows too."""
    monkeypatch.setattr(N, "TILE_QUERIES", 7)
    monkeypatch.setattr(N, "TILE_ROWS", 11)
    monkeypatch.setattr(N, "MEASURED", 13)
    rng = np.random.default_rng(2)
    x = 1e3 + scale * rng.standard_normal((90, 6))
    x[40:60] = x[3]
    ids = np.arange(90)
    ids[70:] = ids[:20]
    best, every = np.full((90, 4), np.inf), np.arange(90)
    cells = [(every, every[:50]), (every, every[50:])]
    found = N._closest(x, ids, np.full(90, np.inf), x, ids, cells, 4, best)
    assert np.allclose(best, brute(x, ids, 4), rtol=1e-14, atol=0)
    assert np.allclose(np.sqrt(((x[:, None] - x[found]) ** 2).sum(2)), best, rtol=1e-14, atol=0) and (ids[found] != ids[:, None]).all()
    whole, limit = best, best[:, 1].copy()
    best = np.full((90, 4), np.inf)
    found = N._closest(x, ids, limit, x, ids, cells, 4, best)
    assert ((found >= 0) == (whole < limit[:, None])).all()


def test_rows_are_sent_to_packs_of_cells(spark, monkeypatch):
    """A row goes to few packs, however many cells there are, and finds what a plain comparison finds."""
    monkeypatch.setattr(N, "PACK_ROWS", 150)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = N.nearest_neighbours(frame, "id", "v", 3, max_pivots=90, cell_rows=40).toPandas().sort_values(["id", "rank"])
    assert np.allclose(got["distance"].to_numpy().reshape(900, 3), brute(x, np.arange(900), 3), atol=1e-12)
    rings = pd.DataFrame({"pivot": [0, 2, 5], "parts": [1, 4, 2], "n": [100, 400, 30]})
    packed = N._packs(rings, 150)
    assert [p[:2] for p in packed] == [(0, 0), *((2, i) for i in range(4)), (5, 0), (5, 1)]
    assert [n for _, _, n in packed] == [0, 1, 2, 3, 4, 4, 4]


def test_values_without_a_product_are_compared_row_by_row(spark):
    rows = [(i, [float(i), 0.0]) for i in range(20)] + [(20, [float("inf"), 0.0])]
    got = N.nearest_neighbours(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", 2)
    near = {(r["id"], r["distance"]) for r in got.where(F.col("id") < 20).collect()}
    assert near == {*((i, 1.0) for i in range(20)), (0, 2.0), (19, 2.0)}
