"""Compression of vectors to codes of their parts: weighted Lloyd over distinct integer parts.

Components become integers, floor(SCALE * x); each vector is cut into PARTS parts. Equal parts of one position are one weighted row, so that copies cost nothing in the rounds, each of which is one pass over the
distinct rows, with sums for each entry and task only. Codes and errors are joined back to the vectors by position and part; parts that many vectors share are joined by broadcast, the others by a shuffle. All arithmetic
is in integers.

Cases: rows whose vector is null, or holds null or non-finite components, are left out. Repeated rows, and rows of one id, each count and have a row in the result. Of equal vec_ids the vector that is least is first; null ids come
last. With fewer than ENTRIES vectors the codebooks have as many entries as there are vectors; without any, no rows. Vectors whose length is not that of the longest, or no multiple of PARTS, are taken with zeros at
their end. Integer components beyond 2^26 either way count as that, so that sums of squares fit 63 bits. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.joins import BROADCAST_IDS, beside
from vellumine.plans.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LARGEST = 1 << 26
#: A part that more than this share of all vectors has is joined by broadcast: of each position there are at most 100.
HOT = 0.01
#: Vectors whose distances are computed at once.
AT_ONCE = 1000


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row (a number of its own), vec_id, label, ints."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector_col, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    own = vectors.where(F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return own.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("ints"))


def _parts(rows: DataFrame, width: int) -> DataFrame:
    """row, vec_id, label, pos, part."""
    padded = F.concat("ints", F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size("ints")))
    each = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.slice(padded, i * width + 1, F.lit(width)))
    return rows.select("row", "vec_id", "label", F.posexplode(each).alias("pos", "part"))


def _matrix(parts: pa.Array, width: int) -> np.ndarray:
    return np.asarray(parts.flatten()).astype(np.int64).reshape(len(parts), width)


def nearest(x: np.ndarray, pos: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each part's codebook, of equal ones the first."""
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), AT_ONCE):
        at = slice(lo, lo + AT_ONCE)
        d = ((x[at, None, :] - books[pos[at]]) ** 2).sum(axis=2)
        code[at] = d.argmin(axis=1)
        far[at] = np.take_along_axis(d, code[at, None], axis=1)[:, 0]
    return code, far


def _sums(books: np.ndarray):
    """pos, entry, n, total: weights and weighted sums of the parts nearest to each entry, once a task."""

    def run(batches):
        parts, entries, width = books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for b in batches:
            pos, weight = np.asarray(b.column(0)), np.asarray(b.column(2))
            x = _matrix(b.column(1), width)
            code, _ = nearest(x, pos, books)
            np.add.at(n, (pos, code), weight)
            np.add.at(total, (pos, code), x * weight[:, None])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["pos", "entry", "n", "total"])

    return run


def _codes(books: np.ndarray):
    def run(batches):
        for b in batches:
            code, far = nearest(_matrix(b.column(1), books.shape[2]), np.asarray(b.column(0)), books)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(code, pa.int32()), pa.array(far)], ["pos", "part", "entry", "far"])

    return run


def codebooks(distinct: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component) after rounds of weighted Lloyd over pos, part, n. The driver gets a row for each entry in each round."""
    books, width = start.copy(), start.shape[2]
    for _ in range(rounds):
        sums = distinct.select("pos", "part", "n").mapInArrow(_sums(books), "pos int, entry int, n long, total array<long>")
        for r in sums.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[j]) for j in range(width))).alias("total")).collect():
            books[r.pos, r.entry] = [t // r.n for t in r.total]
    return books


def compress(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every vector, and the final codebooks: code has two hex digits for each part, error is the sum of squared distances to the entries."""
    scratch = Scratch(spark, "codes")
    rows = scratch.write(_rows(vectors, id_col, vector_col, label_col), "rows")
    kept, longest = rows.agg(F.count("*"), F.max(F.size("ints"))).first()
    width = -(-(longest or 0) // PARTS)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints").collect()
    start = np.zeros((len(first), PARTS * width), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r.ints)] = r.ints
    start = start.reshape(len(first), PARTS, width).transpose(1, 0, 2)
    parts = _parts(rows, width)
    distinct = scratch.write(parts.groupBy("pos", "part").agg(F.count("*").alias("n")), "distinct")
    if not kept:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), start
    books = codebooks(distinct, start)
    found = lambda df: df.select("pos", "part").mapInArrow(_codes(books), "pos int, part array<int>, entry int, far long")
    hot = F.col("n") > HOT * kept
    often = scratch.write(found(distinct.where(hot)), "often")
    coded = parts.join(F.broadcast(often), ["pos", "part"]).unionByName(parts.join(F.broadcast(often), ["pos", "part"], "left_anti").join(found(distinct.where(~hot)), ["pos", "part"]))
    pair = F.struct("pos", F.lower(F.lpad(F.hex("entry"), 2, "0")).alias("hex"))
    whole = coded.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.array_sort(F.collect_list(pair)).alias("pairs"), F.sum("far").alias("error"))
    return whole.select("vec_id", "label", F.array_join(F.transform("pairs", lambda p: p["hex"]), "").alias("code"), "error"), books


def label_errors(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over the rows of its label; null is a label. Sums are made before they are joined, and are sent to every task where labels are few."""
    coded = Scratch(spark, "errors").write(coded, "coded")
    coded = coded.withColumn("__none", F.col("label").isNull()).withColumn("__label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = coded.groupBy("__none", "__label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return beside(coded, sums, ["__none", "__label"], sums.limit(BROADCAST_IDS + 1).count(), "inner").drop("__none", "__label")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' components as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
