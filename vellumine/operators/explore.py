"""Exploring items: tokens, facets, search with evidence, relevance, neighbours, passages, links and hops.

Cases, unless an operator says otherwise: a null body or text has no words and is found by nothing. Empty tables give no rows. Repeated rows
count, and are found, as often as they stand. Ties are broken by id in ascending order. Other columns are ignored.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import snippet, words
from vellumine.operators.nearest import neighbours_approx as neighbours_approx
from vellumine.operators.quotes import AUTOMATON, places
from vellumine.plans.scratch import Scratch, ship

#: A side is broadcast up to this many rows, counted first; beyond it Spark shuffles.
FEW = 100_000
#: Queries that are broadcast at once, queries and vectors of a block, and rows of a product of blocks; cosines this near by a product of matrices are told apart by exact ones.
VECTORS, ASKED, MET, AT_ONCE, NEAR = 20_000, 512, 4096, 128, 2e-6
#: Passages of up to so many automatons are sought by them alone.
PASSES = 8
#: Items of a block, on average, of the queries and of what they are compared with.
BLOCK, WIDE = 1024, 2048
#: Bytes of the texts of a block, on average.
BLOCK_BYTES = 16 << 20
#: Postings, and pairs of items, that are counted at once.
CELLS = 1 << 19
#: Blocks of queries that are broadcast at once.
SENT = 8
#: Share of a block's sets from which on a word is counted by a product of matrices, and cells of a block's matrix at most.
DENSE, MATRIX = 1 / 16, 1 << 22


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def tokens(items: DataFrame) -> DataFrame:
    """kind, item_id, pos (1-based), w."""
    return items.select("kind", "item_id", F.posexplode(words(F.col("body"))).alias("p", "w")).select("kind", "item_id", (F.col("p") + 1).cast("long").alias("pos"), "w")


def word_counts(items: DataFrame) -> DataFrame:
    """w, n, df: how often each word occurs, and in how many items. An item's words are told apart within its row, so one shuffle of partial sums is enough."""
    one = lambda n, df: lambda w: F.struct(w.alias("w"), F.lit(n).alias("n"), F.lit(df).alias("df"))
    each = items.select(words(F.col("body")).alias("ws")).select(F.inline(F.concat(F.transform("ws", one(1, 0)), F.transform(F.array_distinct("ws"), one(0, 1)))))
    return each.groupBy("w").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def filter_items(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have these values; pushed to the scan."""
    for name, value in equal.items():
        df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def facets(df: DataFrame, *cols: str) -> DataFrame:
    """Counts of all combinations of the columns and their subtotals."""
    return df.cube(*cols).agg(F.count("*").alias("n"))


def search(items: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k best items of each kind, with the first match and the tokens around it. No shuffle but for the ranks: an item's words stay in its row."""
    w = items.select("kind", "item_id", words(F.col("body")).alias("w"))
    hit = F.filter("w", lambda x: x.isin(terms))
    found = w.select("kind", "item_id", F.size(hit).cast("long").alias("hits"), F.size(F.array_distinct(hit)).cast("long").alias("terms"), F.array_min(F.transform(F.array(*map(F.lit, terms)), lambda t: F.nullif(F.array_position("w", t), F.lit(0)))).cast("long").alias("tok_pos"), "w").where("hits > 0")
    found = found.select("kind", "item_id", "hits", "terms", "tok_pos", snippet(F.col("w"), F.col("tok_pos").cast("int")).alias("snippet"))
    rank = Window.partitionBy("kind").orderBy(F.desc("terms"), F.desc("hits"), "item_id")
    return found.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k)


def bm25(items: DataFrame, terms: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k most relevant items. Sizes and frequencies come from one pass over the texts, which is kept as a few numbers for each item."""
    w = words(F.col("body"))
    base = items.select("kind", "item_id", w.alias("w"))

    def times(term: str):
        return F.size(F.filter("w", lambda x: x == term)).cast("long")

    each = base.select("kind", "item_id", F.size("w").cast("long").alias("len"), *(times(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    each = Scratch(items.sparkSession, "bm25").write(each, "each")
    stats = each.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))))
    df = each.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return df.select("kind", "item_id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "kind", "item_id").limit(k)


def _ranked(sim: DataFrame, k: int) -> DataFrame:
    rank = Window.partitionBy("q_id").orderBy(F.desc("sim"), "vec_id")
    return sim.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k)


def _six(x: np.ndarray) -> np.ndarray:
    """x in millionths, half away from zero by its decimal digits, as F.round does."""
    millions = x * 1e6
    out = np.rint(millions)
    for i in np.flatnonzero(np.abs(millions - np.floor(millions) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _matrices(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By their length, vectors without a null: their places, the vectors in double precision and their squared norms, added up in order."""
    size = np.where(np.asarray(lists.is_valid()), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64), 0)
    flat = lists.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    holes = np.zeros(len(flat) + 1, np.int64)
    holes[1:] = np.cumsum(np.asarray(flat.is_null()))
    whole = (size > 0) & (holes[ends] == holes[ends - size])
    out = {}
    for n in np.unique(size[whole]):
        at = np.flatnonzero(whole & (size == n))
        x = values[(ends - size)[at][:, None] + np.arange(n)]
        out[int(n)] = at, x, np.cumsum(x * x, axis=1)[:, -1]
    return out


def _cosines(k: int):
    """Two blocks of (id, vector): for each of the first, its k best of the second by rounded cosine, then id. A product of matrices finds which can be among them; their cosines are added up in order, as `cosine` does, and compared by those."""
    none, own = -4.0, -8.0  # below all cosines: of no cosine, and of the query itself

    def run(batches):
        for b in batches:
            for qs, vs in zip(b.column(0), b.column(1), strict=True):
                q_id, v_id = (np.asarray(x.values.field("id")) for x in (qs, vs))
                q, v = (_matrices(x.values.field("v")) for x in (qs, vs))
                shape = {n: (np.full(len(q_id), -1), m) for n, m in q.items()}
                for at, m in shape.values():
                    at[m[0]] = np.arange(len(m[0]))
                for lo in range(0, len(q_id), AT_ONCE):
                    ids = q_id[lo : lo + AT_ONCE]
                    sims = np.full((len(ids), len(v_id)), none)
                    with np.errstate(all="ignore"):
                        for n in q.keys() & v.keys():
                            q_at, x, xx = q[n]
                            here = (q_at >= lo) & (q_at < lo + AT_ONCE)
                            norm = np.sqrt(np.outer(xx[here], v[n][2]))
                            found = (x[here] @ v[n][1].T) / norm
                            found = np.where(np.isnan(found), np.inf, np.maximum(found, -2.0))  # not a number ranks first
                            sims[np.ix_(q_at[here] - lo, v[n][0])] = np.where(norm == 0, none, found)
                    sims[ids[:, None] == v_id] = own
                    least = np.partition(sims, max(0, len(v_id) - k), axis=1)[:, max(0, len(v_id) - k)]
                    row, col = np.nonzero((sims >= least[:, None] - NEAR) & (sims > own))
                    exact = np.full(len(row), none)
                    with np.errstate(all="ignore"):
                        for n in q.keys() & v.keys():
                            place = np.full(len(v_id), -1)
                            place[v[n][0]] = np.arange(len(v[n][0]))
                            which = np.flatnonzero((shape[n][0][row + lo] >= 0) & (place[col] >= 0) & (sims[row, col] > none))
                            for some in np.array_split(which, max(1, -(-len(which) * n // (1 << 21)))):
                                i, j = shape[n][0][row[some] + lo], place[col[some]]
                                exact[some] = np.cumsum(q[n][1][i] * v[n][1][j], axis=1)[:, -1] / np.sqrt(q[n][2][i] * v[n][2][j])
                    key = np.where(np.isnan(exact), np.inf, exact)
                    finite = np.isfinite(key)
                    key[finite] = _six(key[finite])
                    order = np.lexsort((v_id[col], -key, row))
                    begins = np.searchsorted(row[order], np.arange(len(ids)))
                    best = order[np.arange(len(order)) - begins[row[order]] < k]
                    sim = pa.array(exact[best], pa.float64(), mask=exact[best] == none)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[best]], pa.int64()), pa.array(v_id[col[best]], pa.int64()), sim], ["q_id", "vec_id", "sim"])

    return run


def _packed(size: int):
    """Rows of (id, v) of a partition as rows of a list each, of up to `size` and what the last batch has over."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(pa.StructArray.from_arrays(b.columns, ["id", "v"]))
            n += b.num_rows
            if n >= size:
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(held))], ["rows"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays(held))], ["rows"])

    return run


def neighbours(vecs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of each query by cosine, exactly: every query meets every vector, so the work grows with both. Queries in blocks of ASKED are broadcast, VECTORS of them on average at once, and meet blocks of MET vectors as
    matrices; each keeps its best of each query before the shuffle. The cosine with a zero vector, or of unlike lengths, is null and ranks last. Rows without an id are no neighbours and have none."""
    spark = vecs.sparkSession
    ship(spark)
    kind = vecs.schema["embedding"].dataType.simpleString()
    rows = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")).where("id is not null")
    q = rows(queries)
    n = max(1, -(-q.count() // ASKED))
    asked = q.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("qs"))
    met = rows(vecs).mapInArrow(_packed(MET), f"rows array<struct<id: bigint, v: {kind}>>").repartition(2 * spark.sparkContext.defaultParallelism)
    each = max(1, VECTORS // ASKED)
    parts = [F.broadcast(asked.where((F.col("block") >= lo) & (F.col("block") < lo + each)).select("qs")).crossJoin(met).select("qs", "rows") for lo in range(0, n, each)]
    found = reduce(DataFrame.unionAll, parts).mapInArrow(_cosines(k), "q_id long, vec_id long, sim double")
    return _ranked(found.select("q_id", "vec_id", F.round("sim", 6).alias("sim")), k)


def evidence(docs: DataFrame, passages: DataFrame, most: int = PASSES * AUTOMATON) -> DataFrame:
    """doc_id, item_id, pos, len of each passage found whole in a document, at its first place, in characters of the text as it stands; a row for each row of a document and of a passage that meet.

    Passages of up to `most` bytes in all are sought by automatons in few passes over the documents, which are neither joined nor shuffled (quotes.places). More are joined: a passage's first and last word may be parts of
    a text's words, those between are whole, so passages of four words or more meet texts by the hash of their second and third word, and those of three by their second; both join hashes with ids alone, and texts are fetched
    for what met. Passages of one or two words hold no whole word to join by and stay with the automatons. Null and empty passages are found nowhere, and rows without an id are not reported.
    """
    spark = docs.sparkSession
    if (passages.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= most:
        return places(docs, passages, first=True)
    scratch = Scratch(spark, "evidence")
    split = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    p = passages.where("length(text) > 0 and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("passage"), split.alias("w"))
    key = F.when(F.size("w") >= 4, F.xxhash64(F.lit(2), F.get("w", F.lit(1)), F.get("w", F.lit(2)))).when(F.size("w") == 3, F.xxhash64(F.lit(1), F.get("w", F.lit(1))))
    p = scratch.write(p.select("item_id", "passage", key.alias("h")), "passages")
    own = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pair = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.lit(2), F.get("w", i), F.get("w", i + 1)))
    single = F.transform("w", lambda w: F.xxhash64(F.lit(1), w))
    keys = F.array_distinct(F.concat(single, F.when(F.size("w") >= 2, pair).otherwise(F.array().cast("array<bigint>"))))
    met = scratch.write(own.select("doc_id", split.alias("w")).select("doc_id", F.explode(keys).alias("h")).join(few(p.where("h is not null").select("item_id", "h")), "h").select("doc_id", "item_id").distinct(), "met")
    found = own.join(few(met), "doc_id").join(p.where("h is not null").select("item_id", "passage"), "item_id").where(F.contains("text", "passage"))
    found = found.select("doc_id", "item_id", F.instr("text", F.col("passage")).cast("long").alias("pos"), F.length("passage").cast("long").alias("len"))
    return found.unionByName(places(docs, p.where("h is null").select("item_id", F.col("passage").alias("text")), first=True))


def grounded(items: DataFrame, ev: DataFrame, key: str = "doc_id") -> DataFrame:
    return items.join(ev.select(key), key, "left_semi")


def ungrounded(items: DataFrame, ev: DataFrame, key: str = "doc_id") -> DataFrame:
    return items.join(ev.select(key), key, "left_anti")


def _postings(y_sets: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Of a block of sets: the words; each word's column in a matrix of the words that stand in a share of DENSE of the sets, or -1; that matrix, by sets and words; for the others, where each word's postings begin, how many there are and whose
    they are; and the sizes of the sets. A product of matrices counts what many sets share, postings the rest."""
    size = np.asarray(y_sets.value_lengths()).astype(np.int64)
    y = np.asarray(y_sets.flatten())
    order = np.argsort(y, kind="stable")
    keys, first, many = np.unique(y[order], return_index=True, return_counts=True)
    holder = np.repeat(np.arange(len(size)), size)[order]
    often = np.flatnonzero(many >= max(2, DENSE * len(size)))
    often = often[np.argsort(-many[often], kind="stable")[: max(1, MATRIX // len(size))]]
    column = np.full(len(keys), -1)
    column[often] = np.arange(len(often))
    matrix = np.zeros((len(often), len(size)), np.float32)
    of = np.repeat(column, many)
    matrix[of[of >= 0], holder[of >= 0]] = 1
    return keys, column, matrix, first, np.where(column < 0, many, 0), holder, size


def _shared(k: int):
    """Two blocks of (id, set): for each of the first, its k best of the second by rounded Jaccard, then id. Postings of the second block are
    counted, so that all words count and no shared word becomes a row. The join gives the rows of a second block one after another, so its postings are made once."""

    def run(batches):
        block = None
        for b in batches:
            for nth, xs, ys in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if nth != block:
                    block, y_id = nth, ys.values.field("id")
                    keys, column, matrix, first, many, holder, dn = _postings(ys.values.field("set"))
                    by_id = np.empty(len(y_id), np.int64)
                    named = y_id.to_pylist()
                    by_id[sorted(range(len(named)), key=named.__getitem__)] = np.arange(len(named))
                x_id, x_sets = xs.values.field("id"), xs.values.field("set")
                sn, x = np.asarray(x_sets.value_lengths()).astype(np.int64), np.asarray(x_sets.flatten())
                at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                hit = keys[at] == x
                of, at = np.repeat(np.arange(len(sn)), sn)[hit], at[hit]
                begins = np.searchsorted(of, np.arange(len(sn) + 1))
                work = np.concatenate([[0], np.cumsum(many[at])])[begins]  # postings of the queries before
                lo = 0
                while lo < len(sn):
                    hi = min(lo + max(1, CELLS // len(dn)), max(lo + 1, int(np.searchsorted(work, work[lo] + CELLS, "right")) - 1), len(sn))
                    p, row = at[begins[lo] : begins[hi]], of[begins[lo] : begins[hi]] - lo
                    n = many[p]
                    spots = np.repeat(first[p] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    shared = np.bincount(np.repeat(row * len(dn), n) + holder[spots], minlength=(hi - lo) * len(dn)).reshape(hi - lo, len(dn))
                    dense = np.zeros((hi - lo, len(matrix)), np.float32)
                    dense[row[column[p] >= 0], column[p[column[p] >= 0]]] = 1
                    shared = shared + (dense @ matrix).astype(np.int64)  # whole numbers below 2^24, so exact
                    jaccard = shared / (sn[lo:hi, None] + dn - shared)
                    least = np.partition(jaccard, max(0, len(dn) - k), axis=1)[:, max(0, len(dn) - k)]
                    row, col = np.nonzero((jaccard >= least[:, None] - NEAR) & (shared > 0))
                    both = shared[row, col]
                    union = sn[lo + row] + dn[col] - both
                    weight = (both * 2_000_000 + union) // (2 * union)  # six digits, half up, as F.round
                    order = np.lexsort((by_id[col], -weight, row))
                    starts = np.searchsorted(row[order], np.arange(hi - lo))
                    best = order[np.arange(len(order)) - starts[row[order]] < k]
                    row, col = lo + row[best], col[best]
                    yield pa.RecordBatch.from_arrays([x_id.take(pa.array(row)), y_id.take(pa.array(col)), *(pa.array(v, pa.int64()) for v in (sn[row], dn[col], both[best]))], ["src_id", "dst_id", "sn", "dn", "shared"])
                    lo = hi

    return run


def links(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """For each of the queries, the k items with most words of four letters (a to z) in common, by Jaccard over their whole sets of words, as hashes. Exact: no word is left out.

    A query's best items share few words with it (a Jaccard of 0.08 in the test tables), where no prefix of rare words would find them, so each
    query meets every item: queries in blocks of BLOCK are broadcast, SENT of them at once, to each block of WIDE items, which counts shared words and keeps k for each query. So the pairs are never shuffled.
    """

    ship(queries.sparkSession)

    def blocks(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        found = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("body"), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: F.xxhash64(w)))
        rows, wide = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
        n = max(1, -(-rows // size), -(-wide // BLOCK_BYTES))
        own = df.select(F.col("item_id").alias("id"), found.alias("set")).where(F.size("set") > 0)
        return own.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "set")).alias("rows")), n

    (left, m), (right, n) = blocks(queries, BLOCK), blocks(items, WIDE)
    # a task for each block of items, which meets all blocks of queries one after another
    met = right.select("block", F.col("rows").alias("ys")).repartitionById(n, F.col("block").cast("int"))
    sent = [F.broadcast(left.where((F.col("block") >= lo) & (F.col("block") < lo + SENT)).select(F.col("rows").alias("xs"))) for lo in range(0, m, SENT)]
    both = reduce(DataFrame.unionAll, [xs.crossJoin(met).select("block", "xs", "ys") for xs in sent])
    best = both.mapInArrow(_shared(k), "src_id string, dst_id string, sn long, dn long, shared long")
    weight = F.round(F.col("shared") / (F.col("sn") + F.col("dn") - F.col("shared")), 6)
    rank = Window.partitionBy("src_id").orderBy(F.desc("weight"), "dst_id")
    return best.select("src_id", "dst_id", "shared", weight.alias("weight")).withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k)


def hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, hop: what is reached in at most depth steps, each at its least. edges: src, dst; start: id. A join for each step, of the last step's new ids alone;
    edges and each step are written once, so nothing is computed again and the plan does not grow with depth. Edges with a null end lead nowhere; a null start is dropped."""
    scratch = Scratch(edges.sparkSession, "hops")
    edges = scratch.write(edges.where("src is not null and dst is not null").select("src", "dst"), "edges")
    front = scratch.write(start.where("id is not null").select("id", F.lit(0).cast("long").alias("hop")).distinct(), "0")
    seen = front
    for i in range(1, depth + 1):
        near = edges.join(few(front.select(F.col("id").alias("src"))), "src").select(F.col("dst").alias("id")).distinct()
        front = scratch.write(near.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(i).cast("long")), str(i))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def copies(docs: DataFrame) -> DataFrame:
    """first_id and size of each group of equal texts. Null texts are copies of nothing."""
    return docs.where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size")).where("size > 1").select("first_id", "size")


def activity(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their value by window and type."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def thread(conversations: DataFrame) -> DataFrame:
    """Each turn with the role before it and its place."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.row_number().over(w).cast("long").alias("place"))
