"""The approximate index: recall, how little it looks at, and awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.operators import explore, nearest

VEC = "vec_id long, embedding array<float>, row int, cell string, q int"


def vectors(spark, x, first=0):
    """Extra columns with names that the operator uses within."""
    return spark.createDataFrame([(first + i, None if v is None else [float(y) for y in v], 1, "c", 2) for i, v in enumerate(x)], VEC)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(80, 24))
    return vectors(spark, centre[rng.integers(0, 80, 6000)] + 0.25 * rng.normal(size=(6000, 24))).repartition(4).cache()


def pairs(df):
    return {(r["q_id"], r["vec_id"]) for r in df.collect()}


def test_recall_and_share_of_clustered_vectors_that_is_touched(spark, clustered):
    asked = clustered.where("vec_id % 50 = 0")
    exact = explore.neighbours(clustered, asked, 10)
    got = nearest.neighbours_approx(clustered, asked, 10)
    assert len(pairs(got) & pairs(exact)) >= 0.9 * 1200
    same = got.join(exact.select("q_id", "vec_id", F.col("sim").alias("exact")), ["q_id", "vec_id"])
    assert same.where("sim <> exact").count() == 0  # cosines are exact
    model = nearest.fit(clustered, 10)
    index = nearest.build(clustered, model)
    sizes = {r.cell: r.n for r in index.sizes.collect()}
    x = nearest._unit(np.array([r.embedding for r in asked.collect()], np.float32))
    codes = sum(sizes.get(c, 0) for row in model.cells(x) for c in row) / (len(x) * 6000)
    fetched = nearest.candidates(index, asked.select(F.col("vec_id").alias("q"), "embedding")).count() / (len(x) * 6000)
    assert codes < 0.25 and fetched < 0.05, (codes, fetched)


def test_cells_grow_with_the_vectors(clustered):
    assert len(nearest.fit(clustered, 5).centres) == 77 and len(nearest.fit(clustered.limit(900), 5).centres) == 30
    assert len(nearest.fit(clustered, 5, most=320).centres) == 20  # at least PER_CELL of the sample for each


def test_queries_with_too_few_candidates_are_answered_exactly(spark):
    """More neighbours asked for than any threshold lets through; queries that are like no vector have k neighbours too."""
    rng = np.random.default_rng(3)
    near = np.ones((500, 8)) + 0.05 * rng.normal(size=(500, 8))
    vecs, far = vectors(spark, near), vectors(spark, -np.ones((3, 8)), first=1000)
    got = nearest.neighbours_approx(vecs, far, 4)
    assert got.groupBy("q_id").count().collect() and got.count() == 12
    two = vecs.where("vec_id < 2")
    assert pairs(nearest.neighbours_approx(vecs, two, 600)) == pairs(explore.neighbours(vecs, two, 600)) and len(pairs(explore.neighbours(vecs, two, 600))) == 2 * 499


def test_awkward_vectors(spark):
    rows = [[1, 0, 0], [0.9, 0.1, 0], None, [0, 0, 0], [0, 1, 0], [0, 1, 0], [], [1, 0]]
    vecs = vectors(spark, rows).unionByName(vectors(spark, [[1, 0, 0]]))
    got = {(r.q_id, r.vec_id, r["rank"]): r.sim for r in nearest.neighbours_approx(vecs, vecs.where("vec_id in (2, 3, 4)"), 3).collect()}
    assert {k[0] for k in got} == {3, 4} and got[4, 5, 1] == 1.0
    assert all(v is None for k, v in got.items() if k[0] == 3)
    assert nearest.neighbours_approx(vecs.limit(0), vecs, 3).count() == 0 and nearest.neighbours_approx(vecs, vecs.limit(0), 3).count() == 0
    one = vectors(spark, [[1.0, 2.0]])
    assert nearest.neighbours_approx(one, one, 3).count() == 0
