import hashlib
import math
import random

import numpy as np
import pytest

from quirelake.llm.clustering import integers, lloyd, nearest, with_inertia

LONGEST = (1 << 63) - 1


def brute(rows, clusters, rounds, width, seed="3:"):
    """Plain Python integers: {id: (cluster, distance)}, centroids and inertias; ids must differ."""
    kept = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)}
    first = sorted(kept, key=lambda i: (i is None, hashlib.sha256(f"{seed}{i}".encode()).hexdigest()))[:clusters]
    centroids = [kept[i] for i in first]

    def assign():
        out = {}
        for i, v in kept.items():
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out[i] = (d.index(min(d)), min(d))
        return out

    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            mine = [kept[i] for i, (c, _) in found.items() if c == k]
            if mine:
                centroids[k] = [sum(column) // len(mine) for column in zip(*mine)]
    found = assign()
    return found, centroids, [sum(d for c, d in found.values() if c == k) for k in range(len(centroids))]


SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "d", "i") for i, v in rows], SCHEMA)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 6))
    rows = [(i, (centres[i % 5] + 0.3 * rng.standard_normal(6)).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a third of all rows are one vector
    rows += [(2000, None), (2001, [1.0]), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, []), (2006, [-0.0005] * 6)]
    got, found = lloyd(table(spark, rows).repartition(7), clusters=8, rounds=4, width=6, seed="3:")
    want, centroids, inertias = brute(rows, 8, 4, 6)
    assert {r.id: (r.cluster, r.distance) for r in got.collect()} == want
    assert found.centroids == centroids and found.inertias == inertias
    one = with_inertia(got, found).filter("id = 7").first()
    assert one.inertia == sum(inertias) and one.cluster_inertia == inertias[one.cluster]
    assert one.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[one.cluster])).encode()).hexdigest()


@pytest.mark.parametrize("size", [1e6, 1e20, 3e38])
def test_components_of_any_size_stay_exact(spark, size):
    r = random.Random(2)
    rows = [(i, [r.uniform(-size, size) for _ in range(3)]) for i in range(40)]
    got, found = lloyd(table(spark, rows).repartition(3), clusters=3, rounds=3, width=3, seed="3:")
    want, centroids, inertias = brute(rows, 3, 3, 3)
    assert {x.id: (x.cluster, x.distance) for x in got.collect()} == {i: (c, min(d, LONGEST)) for i, (c, d) in want.items()}
    assert found.centroids == centroids and found.inertias == inertias


def test_defined_cases(spark):
    rows, found = lloyd(table(spark, []), clusters=8, rounds=2, width=2, seed="3:")
    assert rows.count() == 0 and found.centroids == [] and with_inertia(rows, found).columns[-1] == "centroid_sha256"
    # Fewer vectors than clusters; ties to the lower number; repeated rows and null ids are clustered.
    few = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [2.0, 0.0]), (None, [2.0, 0.0])]
    rows, found = lloyd(table(spark, few), clusters=8, rounds=3, width=2, seed="3:")
    assert found.centroids == [[0, 0], [0, 0], [2048, 0], [2048, 0]] and found.sizes == [2, 0, 2, 0]
    assert sorted((r.cluster, r.distance) for r in rows.collect()) == [(0, 0), (0, 0), (2, 0), (2, 0)]


def test_ties_and_widening():
    assert nearest(np.array([[1, 0]]), [[0, 0], [2, 0]])[0].tolist() == [0]
    assert integers([np.array([0.5, -0.0001])], 1024).tolist() == [[512, -1]]
    wide = integers([np.array([1e300])], 1024)
    assert wide.tolist() == [[int(1e300) * 1024]]

