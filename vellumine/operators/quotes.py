"""Evidence as quotes: hits and passages with their place in characters of the text as it stands, so that substr(body, start, length) gives each back.

Cases: a null or empty text or passage has no words, holds nothing and is found nowhere. Empty tables give no rows. Repeated rows count, and are found, as often as they stand. Ties are broken by id in ascending order. Texts may be
of any length. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import word_spans, words
from vellumine.plans.scratch import ship

#: Bytes of passages of one automaton, which every Python worker builds once; more passages are sought in several passes.
AUTOMATON = 4 << 20
FOUND = "doc_id long, item_id long, at array<long>, len long"


def token_spans(items: DataFrame) -> DataFrame:
    """kind, item_id, pos (1-based), w, start, stop: tokens with their place in the text; no shuffle."""
    spans = items.select("kind", "item_id", F.posexplode(word_spans(F.col("body"))).alias("p", "s"))
    return spans.select("kind", "item_id", (F.col("p") + 1).cast("long").alias("pos"), "s.w", "s.start", "s.stop")


def search_quotes(items: DataFrame, terms: list[str], k: int, around: int = 2) -> DataFrame:
    """Every hit in the k best items of each kind: kind, item_id, rank, pos (of the token), term, start, stop, quote (the text's own letters), context_start and context, the text from `around` tokens before
    the hit to `around` tokens after it, verbatim.

    Items rank by distinct terms, then hits, then id. Ranks keep the best of each task before the shuffle; only the bodies of these go along, and places are found in the best alone."""
    w = items.select("kind", "item_id", "body", words(F.col("body")).alias("w"))
    hit = F.filter("w", lambda x: x.isin(terms))
    found = w.select("kind", "item_id", "body", F.size(hit).alias("hits"), F.size(F.array_distinct(hit)).alias("terms")).where("hits > 0")
    rank = Window.partitionBy("kind").orderBy(F.desc("terms"), F.desc("hits"), "item_id")
    best = found.withColumn("rank", F.row_number().over(rank).cast("long")).where(F.col("rank") <= k).withColumn("spans", word_spans(F.col("body")))
    each = best.select("kind", "item_id", "rank", "body", "spans", F.posexplode("spans").alias("p", "s")).where(F.col("s.w").isin(terms))
    first = F.get("spans", F.greatest(F.col("p") - around, F.lit(0)))["start"]
    last = F.get("spans", F.least(F.col("p") + around, F.size("spans") - 1))["stop"]
    text = lambda start, stop: F.substring("body", start.cast("int"), (stop - start).cast("int"))
    return each.select(
        "kind", "item_id", "rank", (F.col("p") + 1).cast("long").alias("pos"), F.col("s.w").alias("term"), F.col("s.start").alias("start"), F.col("s.stop").alias("stop"),
        text(F.col("s.start"), F.col("s.stop")).alias("quote"), first.alias("context_start"), text(first, last).alias("context"),
    )


class _Held:
    """Passages of a broadcast by a number that names it in the workers' cache."""

    def __init__(self, shared):
        self.shared = shared


@lru_cache(2)
def _automaton(number: int, held: _Held):
    import ahocorasick

    made = ahocorasick.Automaton()
    for passage, ids in held.shared.value.items():
        made.add_word(passage, (len(passage), passage, ids))
    made.make_automaton()
    return made


def _finder(number: int, shared):
    held = _Held(shared)

    def run(batches):
        seek = _automaton(number, held)
        for b in batches:
            doc, item, at, length = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                seen: dict[str, tuple] = {}
                for end, (n, passage, ids) in seek.iter(text):
                    seen.setdefault(passage, (n, ids, []))[2].append(end - n + 2)
                for n, ids, where in seen.values():
                    doc += [i] * len(ids)
                    item += ids
                    at += [where] * len(ids)
                    length += [n] * len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(length, pa.int64())], ["doc_id", "item_id", "at", "len"])

    return run


def found(docs: DataFrame, passages: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """doc_id, item_id, at, len: for every text and passage that meet, all places of the passage (1-based, in characters, ascending), overlapping ones too.

    All passages stand in an Aho-Corasick automaton, which reads a text once however many passages there are, so documents are neither shuffled nor joined, and a text's places of a passage are one row. Passages of more than `most` bytes in all
    are dealt by a hash to so many automatons, each of them a pass over the documents; what the driver gathers and sends is one automaton's passages at a time. Equal passages share a place in it. Rows without an id are not reported, and
    passages without one not sought."""
    spark = docs.sparkSession
    ship(spark)
    own = passages.where("length(text) > 0 and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // most))
    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = []
    for i in range(parts):
        ids: dict[str, list[int]] = {}
        for r in own.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i).toArrow().to_pylist():
            ids.setdefault(r["text"], []).append(r["item_id"])
        if ids:
            shared = spark.sparkContext.broadcast({text: tuple(sorted(x)) for text, x in ids.items()})
            out.append(texts.mapInArrow(_finder(shared._jbroadcast.id(), shared), FOUND))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], FOUND)


def places(docs: DataFrame, passages: DataFrame, first: bool = False, most: int = AUTOMATON) -> DataFrame:
    """doc_id, item_id, pos, len: found() with a row for every place, or with `first` for the first place of each passage in each text."""
    each = found(docs, passages, most)
    return each.select("doc_id", "item_id", (F.col("at")[0] if first else F.explode("at")).alias("pos"), "len")
