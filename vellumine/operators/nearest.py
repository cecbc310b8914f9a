"""Approximate neighbours by cosine: cells and product-quantised codes choose few vectors, which are compared exactly.

Unit vectors stand in the cell of their nearest centre; what is left is cut into parts of WIDTH components, each kept as one byte, the nearest of 256 entries for its position. A query looks through the cells nearest to it, where it
meets codes instead of vectors, and those whose approximate cosine passes its threshold are fetched and compared exactly. Cells grow with the root of the number of vectors. Centres, entries, the number of cells to look
through and the threshold are fit on at most SAMPLE vectors, so that `recall` of the k nearest in that sample are found; every vector is indexed.

Cases: null vectors are left out. A zero vector stands in some cell, and its cosine is null, which ranks last. Repeated rows are found as often as they stand. No vector is a neighbour of its own id. A query that finds fewer than k
candidates is answered exactly. Without vectors or queries, no rows. Vectors of unlike length are taken with zeros at their end for the index, and a cosine of unlike lengths is null. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions.text import cosine
from vellumine.plans.scratch import Scratch, sample_bound

#: Vectors of the sample at most, of those asked in it, and rounds of fitting.
SAMPLE, ASKED, ROUNDS = 20_000, 500, 10
#: Components of a part, entries for it, and vectors of the sample for each cell at least.
WIDTH, ENTRIES, PER_CELL = 4, 256, 16
#: Codes that a task compares at once: crowded cells are dealt to several tasks.
CROWD = 4096
#: Queries of a block, which is sent to all tasks, and of one product of matrices.
QUERIES, AT_ONCE = 20_000, 256
#: The threshold lets through so many times the candidates that the sample asks for.
SPARE = 1.5


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros for what is null or missing; what is beyond width is cut."""
    out = np.zeros((len(column), width), np.float32)
    size = np.minimum(np.asarray(column.value_lengths()), width)
    for i in range(len(column)):
        if size[i]:
            out[i, : size[i]] = np.nan_to_num(np.asarray(column[i].values.to_numpy(zero_copy_only=False), np.float32)[: size[i]])
    return out


def _means(x: np.ndarray, n: int, turn: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """n centres of x by rounds of k-means; fewer if x has fewer rows."""
    centre = x[turn.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centre)
        total, count = np.zeros_like(centre), np.bincount(own, minlength=len(centre))
        np.add.at(total, own, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(axis=1) / 2 - x @ centre.T).argmin(axis=1)


@dataclass
class Model:
    """centres (cell, component), books (position, entry, component), cells that a query looks through, and the sample's vectors as their codes give them, with the rank in them that is the threshold."""

    centres: np.ndarray
    books: np.ndarray
    probed: int
    sample: np.ndarray
    rank: int

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code of unit vectors."""
        cell = _nearest(x, self.centres)
        left = x - self.centres[cell]
        return cell, np.stack([_nearest(left[:, p * WIDTH : (p + 1) * WIDTH], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([book[code[:, p]] for p, book in enumerate(self.books)], axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cells that unit vectors look through."""
        return np.argsort((self.centres**2).sum(axis=1) / 2 - x @ self.centres.T, axis=1, kind="stable")[:, : self.probed]

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        """The approximate cosine that candidates of unit vectors must reach; what is in the sample itself is not counted out, so one more passes."""
        if self.rank >= len(self.sample):
            return np.full(len(x), -9.0)
        sim = x @ self.sample.T
        return np.partition(sim, len(self.sample) - self.rank, axis=1)[:, len(self.sample) - self.rank]


def fit(vecs: DataFrame, k: int, recall: float = 0.95, cells: int | None = None, most: int = SAMPLE) -> Model | None:
    """None if there are no vectors. The sample is the vectors with the least hashes of their ids."""
    turn = F.abs(F.xxhash64("vec_id", F.lit(3)).bitwiseAND(F.lit((1 << 63) - 1)))
    own = vecs.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    total, longest = own.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not total or not longest:
        return None
    rows = own.where(turn <= sample_bound(total, most)).orderBy(turn, "vec_id").limit(most).select("embedding").toArrow()
    width = -(-longest // WIDTH) * WIDTH
    x = _unit(_matrix(rows.column(0).combine_chunks(), width))
    rng = np.random.default_rng(1)
    centres = _means(x, max(1, min(cells or int(np.sqrt(total)), len(x) // PER_CELL or 1)), rng)
    left = x - centres[_nearest(x, centres)]
    books = np.stack([np.resize(_means(left[:, p : p + WIDTH], ENTRIES, rng), (ENTRIES, WIDTH)) for p in range(0, width, WIDTH)])
    model = Model(centres, books, len(centres), x, 1)
    cell, code = model.encode(x)
    model.sample = model.decode(cell, code).astype(np.float32)
    asked = x[:ASKED]
    exact, near = asked @ x.T, asked @ model.sample.T
    own_place = np.arange(len(asked))
    exact[own_place, own_place] = near[own_place, own_place] = -9
    best = np.argsort(-exact, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if best.size:
        part = lambda ranks: int(np.sort(ranks.ravel())[min(ranks.size - 1, int(np.sqrt(recall) * ranks.size))]) + 1
        ranks = lambda score: np.argsort(np.argsort(-score, axis=1, kind="stable"), axis=1)
        order = -((centres**2).sum(axis=1) / 2 - asked @ centres.T)
        model.probed = part(np.take_along_axis(ranks(order), cell[best], axis=1))
        model.rank = int(SPARE * part(np.take_along_axis(ranks(near), best, axis=1))) + 2
    return model


def _coded(model: Model):
    def run(batches):
        for b in batches:
            cell, code = model.encode(_unit(_matrix(b.column(1), model.width)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], ["row", "cell", "code"])

    return run


def _probes(model: Model):
    def run(batches):
        for b in batches:
            x = _unit(_matrix(b.column(1), model.width))
            cells, least = model.cells(x), model.thresholds(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32())), pa.array(least, pa.float32()), pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))], ["q", "unit", "least", "cells"])

    return run


def _passing(model: Model):
    """Codes and queries of a cell: the pairs that reach the query's threshold."""

    def run(codes: pa.Table, asked: pa.Table) -> pa.Table:
        q, row = [], []
        if codes.num_rows and asked.num_rows:
            code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
            near = model.decode(np.asarray(codes.column("cell")), code).astype(np.float32)
            x, least = _matrix(asked.column("unit").combine_chunks(), model.width), np.asarray(asked.column("least"))
            for lo in range(0, len(x), AT_ONCE):
                i, j = np.nonzero(x[lo : lo + AT_ONCE] @ near.T >= least[lo : lo + AT_ONCE, None] - 1e-6)
                q.append(i + lo)
                row.append(j)
        take = lambda column, at: column.combine_chunks().take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))
        return pa.table({"q": take(asked.column("q"), q), "row": take(codes.column("row"), row)})

    return run


@dataclass
class Cells:
    """A written index: vectors by row number, their codes by cell and part of it, and how many parts each cell has."""

    model: Model
    vectors: DataFrame
    codes: DataFrame
    sizes: DataFrame


def build(vecs: DataFrame, model: Model) -> Cells:
    scratch = Scratch(vecs.sparkSession, "cells")
    own = vecs.where("embedding is not null").select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    vectors = scratch.write(own, "vectors")
    codes = scratch.write(vectors.select("row", "embedding").mapInArrow(_coded(model), "row long, cell int, code binary"), "codes")
    sizes = scratch.write(codes.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CROWD).cast("int").alias("parts")), "sizes")  # a row for each cell
    return Cells(model, vectors, codes.join(F.broadcast(sizes.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("parts"), sizes)


def candidates(index: Cells, queries: DataFrame) -> DataFrame:
    """q and row of what reaches the threshold of a query (q, embedding) in the cells that it looks through."""
    probes = queries.select("q", "embedding").mapInArrow(_probes(index.model), "q long, unit array<float>, least float, cells array<int>")
    probes = probes.select("q", "unit", "least", F.explode("cells").alias("cell")).join(F.broadcast(index.sizes.select("cell", "parts")), "cell")
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return index.codes.groupBy("cell", "part").cogroup(probes.groupBy("cell", "part")).applyInArrow(_passing(index.model), "q long, row long")


def neighbours_approx(vecs: DataFrame, queries: DataFrame, k: int, recall: float = 0.95, cells: int | None = None) -> DataFrame:
    """q_id, vec_id, sim, rank: about the k nearest vectors of each query, with exact cosines rounded to six digits; ties by vec_id."""
    model = fit(vecs, k, recall, cells)
    spark: SparkSession = vecs.sparkSession
    if model is None:
        return ranked(queries.limit(0).select(F.col("vec_id").alias("q_id"), "vec_id", F.lit(0.0).alias("sim")), "q_id", k).select("q_id", "vec_id", "sim", "rank")
    index, scratch = build(vecs, model), Scratch(spark, "asked")
    asked = scratch.write(queries.where("embedding is not null").select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("q_id"), F.col("embedding").cast("array<float>").alias("embedding")), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    best = []
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
        pairs = scratch.write(candidates(index, some), f"pairs{i}")
        sent = F.broadcast(some.select("q", "q_id", F.col("embedding").alias("asked")))
        sim = pairs.join(index.vectors, "row").join(sent, "q").where("q_id <> vec_id").select("q", "q_id", "vec_id", F.round(cosine(F.col("asked"), F.col("embedding")), 6).alias("sim"))
        found = scratch.write(ranked(sim, "q", k), f"found{i}")
        # queries that too few candidates passed for
        short = some.join(found.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= k), "q", "left_anti")
        short = scratch.write(short, f"short{i}")
        best.append(found)
        if short.count():
            full = F.broadcast(short.select("q", "q_id", F.col("embedding").alias("asked"))).join(index.vectors, F.col("q_id") != F.col("vec_id"))
            full = full.select("q", "q_id", "vec_id", F.round(cosine(F.col("asked"), F.col("embedding")), 6).alias("sim"))
            best[-1] = found.join(F.broadcast(short.select("q")), "q", "left_anti").unionByName(ranked(full, "q", k))
    out = best[0]
    for other in best[1:]:
        out = out.unionByName(other)
    return out.select("q_id", "vec_id", "sim", "rank")


def ranked(sim: DataFrame, by: str, k: int) -> DataFrame:
    rank = Window.partitionBy(by).orderBy(F.desc("sim"), "vec_id")
    return sim.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k)
