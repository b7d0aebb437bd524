import math

import numpy as np
import pytest
from cadenza.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row int, shard string, window int"


def brute(rows, positives=5, most=3):
    """All pairs of whole numbers."""
    own = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, (anchor, label, v) in enumerate(own):
        if anchor % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, b) for b, (i, _, w) in enumerate(own))
        near = [(i, -s) for s, i, b in scored if b != a and own[b][1] == label][:positives]
        for pos, p in near:
            fits = [(i, -s) for s, i, b in scored if own[b][1] != label and 50 * p <= -100 * s <= 95 * p]
            out += [(anchor, pos, k + 1, i, p, s) for k, (i, s) in enumerate(fits[:most])]
    return sorted(out)


def rows_of(n, seed, size=12, spread=0.2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, size))
    rows = [(i, (centers[i % 6] + rng.normal(size=size) * spread).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(10_000 + i, rows[3][1], i % 3) for i in range(60)]  # one vector many times
    odd = [(None, [1.0] * size, 1), (n + 1, None, 1), (n + 2, [1.0] * size, None), (n + 3, [None] * size, 1), (n + 4, [float("nan")] * size, 1), (n + 5, [float("inf")] * size, 2), (n + 6, [], 1), (n + 7, [1.0, 2.0], 2), (100, rows[0][1], 3), (100, rows[0][1], 3)]
    return rows + odd


@pytest.mark.parametrize("seed,shard", [(1, 4096), (2, 25), (3, 60)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(negatives, "SHARD_ROWS", shard)
    rows = rows_of(500, seed)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in negatives.hard_negatives(table).collect())
    assert got == brute(rows) and len(got) > 50


def test_scans_end_before_all_shards_are_met(spark, monkeypatch):
    """Vectors in tight groups: the bounds leave out a part of the work, and nothing is lost."""
    monkeypatch.setattr(negatives, "SHARD_ROWS", 20)
    monkeypatch.setattr(negatives, "WIDENING", (2,))
    rows = rows_of(1200, 4, spread=0.01)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    dealt = []
    deal = negatives._dealt
    monkeypatch.setattr(negatives, "_dealt", lambda *a: dealt.append((a[3], deal(*a))) or dealt[-1][1])
    assert sorted(tuple(r) for r in negatives.hard_negatives(table).collect()) == brute(rows)
    shards = len({r.shard for _, d in dealt for r in d.select("shard").distinct().collect()})
    asked = dealt[0][1].select("row").distinct().count()
    last = [d.count() for seen, d in dealt if seen == 2][0]  # the rest of the positives' search
    assert last < 0.75 * asked * (shards - 2)


def test_large_components_and_empty_tables(spark):
    rows = [(50, [3.0e5, -2.0e5], 1), (1, [3.1e5, 1.0], 1), (2, [2.0e5, 7.0], 2), (3, [1.9e5, 0.5], 3), (100, [1e30, 0.0], 1)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    small = [r for r in rows if r[0] != 100]
    got = sorted(tuple(r) for r in negatives.hard_negatives(table.where("vec_id < 100")).collect())
    assert got == brute(small)
    assert negatives.hard_negatives(table).count() >= len(got)
    assert negatives.hard_negatives(table.limit(0)).count() == 0
    assert negatives.hard_negatives(table.where("vec_id = 1")).count() == 0
