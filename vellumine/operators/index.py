"""A stored inverted index: postings in blocks by falling impact, written once, and the best items of a query from the top of its words' blocks.

index/blocks is partitioned by bucket of the word, so a query reads the folders of its words alone. A block holds up to BLOCK postings of one word and one level; a level is a span of impact (what a posting adds to a score, without
its word's weight), and a block says the greatest impact in it. index/items has one row for all items: how many, and their mean length.

A query reads levels from the top. Once even the best of what is unread could not lift an unseen item to the k-th score so far, no further item is looked for; for those seen that may still win, the missing postings
are fetched. So all scores are those of a full scan.

Cases: a null body has no words. An empty table makes an index that finds nothing. Of items with one kind and id the words add up, as if of one text each. Ties are broken by kind and id. Unknown words find nothing; a word asked for twice counts
twice. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.text import words
from vellumine.operators.explore import few
from vellumine.plans.scratch import Scratch, ship

#: Postings of a block at most, and levels of impact.
BLOCK, LEVELS = 512, 24
#: Items for each bucket of words, and the least and the most buckets.
PER_BUCKET, BUCKETS = 50_000, (8, 4096)
#: Parts of a bucket at least, and words of the texts for each part: a part is one task, so what a task reads does not grow with the input. Postings of a word are dealt to all parts of its bucket when it stands in this many of the items
#: that are sorted at once; other words have one part.
PARTS, PER_PART, OFTEN = 8, 1_000_000, 1024
#: Words of the items that are sorted at once before the shuffle, and rows of a batch given back.
TOGETHER, ROWS = 2_000_000, 20_000
#: A step reads levels until it has so many times the postings that the step before had.
WIDER = 8
#: Scores are rounded to six digits; what could differ by less is not ruled out.
NEAR = 2e-6
K1, B = 1.2, 0.75


def _impact(tf, length, mean: float, k1: float = K1, b: float = B):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of up to TOGETHER words, so that fewer lists of a word are shuffled."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b.column(1).flatten())
        if n >= TOGETHER:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _postings(mean: float):
    """For each word and level the items that have it, of many items at once. Columns: w, level, deal, top, items, tf, len."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in _gathered(batches):
            items, lists = (b.column(i).chunk(0) for i in range(2))
            length = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            code = np.asarray(coded.indices).astype(np.int64)
            pair, tf = np.unique(code * len(lists) + np.repeat(np.arange(len(lists)), length), return_counts=True)
            code, doc = pair // len(lists), pair % len(lists)
            impact = _impact(tf, length[doc], mean)
            level = np.minimum(LEVELS - 1, (impact * (LEVELS / (K1 + 1))).astype(np.int64))
            key = code * LEVELS + (LEVELS - 1 - level)
            order = np.argsort(key, kind="stable")
            key, doc, tf, impact = key[order], doc[order], tf[order], impact[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            code = key[first] // LEVELS
            many = np.bincount(key // LEVELS)[code] >= OFTEN
            deal = np.where(many, zlib.crc32(str(items[0]).encode()) >> 1, -1)
            ends = pa.array(np.append(first, len(doc)), pa.int32())
            held = [pa.ListArray.from_arrays(ends, x) for x in (items.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(length[doc], pa.int32()))]
            top = np.maximum.reduceat(impact, first) if len(first) else impact
            words_ = coded.dictionary.take(pa.array(code)).cast(pa.string())
            made = [words_, pa.array(LEVELS - 1 - key[first] % LEVELS, pa.int32()), pa.array(deal, pa.int32()), pa.array(top), *held]
            batch = pa.RecordBatch.from_arrays(made, ["w", "level", "deal", "top", "items", "tf", "len"])
            for lo in range(0, batch.num_rows, ROWS):
                yield batch.slice(lo, ROWS)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Neighbouring lists of one word and level as blocks of up to BLOCK; lists come sorted by word and level, and a list may be longer. Blocks are cut where a word or level begins and after each BLOCK hits from there on; at most
    one block is held over to the next batch."""
    key, held, n, top = None, None, 0, 0.0  # of the block that is open
    for b in batches:
        size = np.asarray(b.column(4).value_lengths()).astype(np.int64)
        hits = pa.table([b.column(i).flatten() for i in (4, 5, 6)], names=["item_id", "tf", "len"])
        if not b.num_rows:
            continue
        words_, level, bucket, best = (b.column(i) for i in range(4))
        w = words_.dictionary_encode()
        w_code, lv = np.asarray(w.indices).astype(np.int64), np.asarray(level).astype(np.int64)
        new = np.concatenate([[True], (w_code[1:] != w_code[:-1]) | (lv[1:] != lv[:-1])])
        if held is not None and key[:2] == (words_[0].as_py(), level[0].as_py()):
            new[0] = False
        if held is not None:  # the open block comes first
            hits = pa.concat_tables([held, hits])
            size = np.concatenate([[n], size])
            new = np.concatenate([[True], new])
            names = pa.concat_arrays([pa.array([key[0]]), words_.cast(pa.string())])
            lv, buckets, tops = np.concatenate([[key[1]], lv]), np.concatenate([[key[2]], np.asarray(bucket)]), np.concatenate([[top], np.asarray(best)])
        else:
            names, buckets, tops = words_.cast(pa.string()), np.asarray(bucket), np.asarray(best)
        rows = np.flatnonzero(new)
        ends = np.cumsum(size)
        start = (ends - size)[rows]
        total = np.append(start[1:], ends[-1]) - start
        blocks = -(-total // BLOCK)
        of = np.repeat(np.arange(len(rows)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lo = start[of] + nth * BLOCK
        many = np.minimum(BLOCK, total[of] - nth * BLOCK)
        best = np.maximum.reduceat(tops, rows)
        last = len(of) - 1  # stays open
        key, n, top = (names[int(rows[of[last]])].as_py(), int(lv[rows[of[last]]]), int(buckets[rows[of[last]]])), int(many[last]), float(best[of[last]])
        held = hits.slice(int(lo[last]), n).combine_chunks()
        if last:
            at = rows[of[:last]]
            yield _batch(buckets[at], names.take(pa.array(at)), lv[at], best[of[:last]], many[:last], hits.slice(0, int(lo[last])))
    if held is not None:
        yield _batch([key[2]], pa.array([key[0]], pa.string()), [key[1]], [top], [n], held)


def _batch(bucket, w, level, top, size, hits: pa.Table) -> pa.RecordBatch:
    columns = [c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in hits.columns]
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), w, pa.array(level, pa.int32()), pa.array(top, pa.float64()), pa.array(size, pa.int32()), *(pa.ListArray.from_arrays(ends, c) for c in columns)], ["bucket", "w", "level", "top", "n", "items", "tf", "len"])


_HITS = "items array<string>, tf array<int>, len array<int>"


@dataclass
class Index:
    """A written index: where it is, how many items and buckets it has, and their mean length."""

    spark: SparkSession
    path: str
    items: int
    mean: float
    buckets: int

    def blocks(self, terms: list[str]) -> DataFrame:
        """The blocks of these words; the folders of other buckets are not read."""
        found = self.spark.read.schema(f"w string, level int, top double, n int, {_HITS}, bucket int").parquet(f"{self.path}/blocks")
        own = self.spark.range(1).select(*(bucket_of(F.lit(t), self.buckets).alias(str(i)) for i, t in enumerate(terms))).first()
        return found.where(F.col("bucket").isin(*set(own)) & F.col("w").isin(*terms))


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def build(items: DataFrame, path: str) -> Index:
    """Write the index of items (kind, item_id, body) to a folder that all executors share. A batch's postings of one word and level are one row of the only shuffle, which deals words by bucket and part of it, and frequent words to all parts of their bucket."""
    spark = items.sparkSession
    ship(spark)
    # kind and id are one string of a hit: the length of the kind, the kind and the id
    kind, item = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("kind", "item_id"))
    w = items.select(F.concat(F.length(kind).cast("string"), F.lit(":"), kind, item).alias("item"), words(F.col("body")).alias("w"))
    n, mean = w.agg(F.count("*"), F.avg(F.size("w"))).first()
    buckets = int(min(BUCKETS[1], max(BUCKETS[0], n // PER_BUCKET)))
    index = Index(spark, path, n, float(mean or 0) or 1.0, buckets)
    lists = w.mapInArrow(_postings(index.mean), f"w string, level int, deal int, top double, {_HITS}")
    parts = int(max(PARTS, -(-n * index.mean // (buckets * PER_PART))))
    part = F.when(F.col("deal") < 0, F.pmod(F.xxhash64(F.lit(1), "w"), F.lit(parts))).otherwise(F.pmod("deal", F.lit(parts))).cast("int")
    dealt = lists.withColumn("bucket", bucket_of(F.col("w"), buckets)).repartitionById(buckets * parts, F.col("bucket") * parts + part)
    rows = dealt.sortWithinPartitions("bucket", "w", F.desc("level")).select("w", "level", "bucket", "top", "items", "tf", "len")
    blocks = rows.mapInArrow(_blocks, f"bucket int, w string, level int, top double, n int, {_HITS}")
    blocks.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks")
    stats = spark.createDataFrame([(n, index.mean, buckets)], "items long, mean double, buckets int")
    stats.write.parquet(f"{path}/items")
    return index


def load(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    r = spark.read.parquet(f"{path}/items").first()
    return Index(spark, path, r["items"], r["mean"], r["buckets"])


def hits(blocks: DataFrame) -> DataFrame:
    """w, level, kind, item_id, tf, len: a row for each posting of the blocks."""
    each = blocks.select("w", "level", F.inline(F.arrays_zip("items", "tf", "len")))
    size = F.substring_index("items", ":", 1)
    kind = F.substring("items", F.length(size) + 2, size.cast("int"))
    return each.select("w", "level", kind.alias("kind"), F.substring("items", F.length(size) + 2 + size.cast("int"), F.length("items")).alias("item_id"), "tf", "len")


def _shares(each: DataFrame, weights: dict[str, float], mean: float) -> DataFrame:
    """kind, item_id and what each word adds to the item's score, of hits."""
    parts = [F.sum(F.when(F.col("w") == t, F.lit(weights[t]) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean)))).alias(f"s{i}") for i, t in enumerate(weights)]
    return each.groupBy("kind", "item_id").agg(*parts)


def top(index: Index, terms: list[str], k: int, seen: dict | None = None) -> DataFrame:
    """kind, item_id, score of the k best items, as explore.bm25 has them. The driver learns a row for each word and level. seen, if given, is told how many postings there are and how many were read."""
    spark, words_ = index.spark, list(dict.fromkeys(terms))
    seen = {} if seen is None else seen
    blocks = index.blocks(words_)
    heads = {(r.w, r.level): (r.n, r.top) for r in blocks.groupBy("w", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()}
    df = {t: sum(n for (w, _), (n, _) in heads.items() if w == t) for t in words_}
    weights = {t: float(np.log(1 + (index.items - df[t] + 0.5) / (df[t] + 0.5))) for t in words_ if df[t]}
    seen |= {"postings": sum(df.values()), "read": 0, "steps": 0}
    if not weights:
        return spark.createDataFrame([], "kind string, item_id string, score double")
    times = {t: terms.count(t) for t in weights}
    scratch = Scratch(spark, "top")
    place = {t: i for i, t in enumerate(weights)}
    score = lambda: sum((F.coalesce(F.col(f"s{place[t]}"), F.lit(0.0)) for t in terms if t in place), F.lit(0.0))
    levels = {t: sorted((lv for w, lv in heads if w == t), reverse=True) for t in weights}
    want = max(k, 1)
    while True:
        cut = {}
        for t in weights:
            got = 0
            for lv in levels[t]:
                if got >= want:
                    break
                cut[t], got = lv, got + heads[t, lv][0]
        unread = {t: max((heads[t, lv][1] for lv in levels[t] if lv < cut[t]), default=0.0) for t in weights}
        above = None
        for t in weights:
            own = (F.col("w") == t) & (F.col("level") >= cut[t])
            above = own if above is None else above | own
        name = f"step{seen['steps']}"
        partial = scratch.write(_shares(hits(blocks.where(above)), weights, index.mean).withColumn("sum", score()), name)
        rest = sum(times[t] * weights[t] * unread[t] for t in weights)
        seen["steps"] += 1
        seen["read"] += sum(heads[t, lv][0] for t in weights for lv in levels[t] if lv >= cut[t])
        best = [r["sum"] for r in partial.orderBy(F.desc("sum")).limit(k).select("sum").collect()]
        if not any(unread.values()):
            return _ranked(partial.withColumn("score", F.col("sum")), k)
        if len(best) == k and rest < best[-1] - NEAR:
            break
        want *= WIDER
    # what each may still gain: words whose posting it has gain nothing more
    gain = sum((F.when(F.col(f"s{i}").isNull(), times[t] * weights[t] * unread[t]).otherwise(0.0) for i, t in enumerate(weights)), F.lit(0.0))
    live = scratch.write(partial.where(F.col("sum") + gain >= best[-1] - NEAR), "live")
    below = hits(blocks.where(~above)).join(few(live.select("kind", "item_id")), ["kind", "item_id"], "left_semi")
    both = live.drop("sum").unionByName(_shares(below, weights, index.mean)).groupBy("kind", "item_id").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(weights))))
    return _ranked(both.withColumn("score", score()), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return scored.select("kind", "item_id", F.round("score", 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "kind", "item_id").limit(k)
