"""The stored index against a full scan, and what it reads."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumine.operators import explore, index
from vellumine.plans.scratch import Scratch

ITEMS = "kind string, item_id string, body string, w string, hits int, level int, bucket int, sum int, len int"


def items(spark, rows):
    """Extra columns with names that the operators use within."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], ITEMS)


def made(df):
    return index.build(df, f"{Scratch(df.sparkSession, 'index').root}/index")


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in "kmnprstv" for b in ("a", "e", "io", "ù")]
    odds = 1 / np.arange(1, len(words) + 1)
    rows = [("ab"[i % 2], str(i), " ".join(rng.choice(words, int(rng.lognormal(2.5, 1.0)), p=odds / odds.sum()))) for i in range(3000)]
    rows += [("a", "n", None), ("a", "e", ""), ("b", "long", "ka " * 30_000 + "rare"), ("b", "tie1", "rare ka"), ("a", "tie2", "Rare, KA!"), ("a", "only", "single")]
    df = items(spark, rows).repartition(5).cache()
    return df, made(df), words


def test_equal_to_a_full_scan(texts):
    df, own, words = texts
    rng = np.random.default_rng(7)
    asked = [(["rare"], 2), (["none"], 3), ([words[0], words[0], words[5]], 10), (words[:6], 25), ([words[-1], "single"], 100_000), ([], 3), (list(rng.choice(words, 3)), 60)]
    for terms, k in asked:
        want = [tuple(r) for r in explore.bm25(df, terms, k).collect()] if terms else []
        assert [tuple(r) for r in index.top(own, terms, k).collect()] == want, terms


def test_ends_early_and_reads_the_folders_of_its_words_alone(texts):
    _, own, words = texts
    seen = {}
    index.top(own, [words[0], words[1]], 3, seen)
    assert seen["read"] < seen["postings"] / 2
    plan = own.blocks([words[0]])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"EqualTo(w,{words[0]})" in plan


def test_blocks_are_bounded_and_hold_every_posting_once(texts):
    df, own, words = texts
    blocks = own.spark.read.parquet(f"{own.path}/blocks")
    assert blocks.agg(F.max("n")).first()[0] <= index.BLOCK and blocks.where((F.col("n") != F.size("items")) | (F.col("n") != F.size("tf")) | (F.col("n") != F.size("len"))).count() == 0
    each = index.hits(blocks)
    from vellumine.functions.text import words as split

    want = df.select("kind", "item_id", F.explode(split(F.col("body"))).alias("w")).groupBy("kind", "item_id", "w").agg(F.count("*").cast("int").alias("tf"))
    assert each.select("kind", "item_id", "w", "tf").exceptAll(want).count() == 0 and each.count() == want.count()
    least = blocks.select("top", F.inline(F.arrays_zip("tf", "len")))
    impact = F.col("tf") * (index.K1 + 1) / (F.col("tf") + index.K1 * (1 - index.B + index.B * F.col("len") / own.mean))
    assert least.where(impact > F.col("top") + 1e-12).count() == 0


def test_long_lists_are_cut_and_short_ones_joined():
    rows = [("x", 3, 0, 1.0, range(1300)), ("x", 3, 0, 0.9, range(1300, 1400)), ("x", 2, 0, 0.5, range(2)), ("y", 2, 1, 0.4, range(600)), ("y", 2, 1, 0.7, range(600, 700))]
    for cuts in ((1, 4), (2, 3), (5, 5), (0, 3)):
        lo, parts = 0, []
        for hi in (*cuts, len(rows)):
            parts.append(rows[lo:hi])
            lo = hi
        schema = pa.schema([("w", pa.string()), ("level", pa.int32()), ("bucket", pa.int32()), ("top", pa.float64()), ("items", pa.list_(pa.string())), ("tf", pa.list_(pa.int32())), ("len", pa.list_(pa.int32()))])
        batches = [pa.RecordBatch.from_pylist([{"w": w, "level": lv, "bucket": b, "top": t, "items": list(map(str, ids)), "tf": [1] * len(ids), "len": [9] * len(ids)} for w, lv, b, t, ids in part], schema) for part in parts]
        got = [r for b in index._blocks(iter(batches)) for r in b.to_pylist()]
        assert [(r["w"], r["level"], r["bucket"], r["n"]) for r in got] == [("x", 3, 0, 512), ("x", 3, 0, 512), ("x", 3, 0, 376), ("x", 2, 0, 2), ("y", 2, 1, 512), ("y", 2, 1, 188)]
        assert all(r["top"] >= best for r, best in zip(got, (1.0, 1.0, 1.0, 0.5, 0.4, 0.7), strict=True))
        assert [int(i) for r in got for i in r["items"]] == [*range(1400), *range(2), *range(700)]


def test_a_written_index_is_found_again_and_an_empty_one_finds_nothing(spark, texts):
    _, own, words = texts
    again = index.load(spark, own.path)
    assert [tuple(r) for r in index.top(again, words[:2], 5).collect()] == [tuple(r) for r in index.top(own, words[:2], 5).collect()]
    none = made(items(spark, [("a", "1", None)]).limit(0))
    assert index.top(none, ["ka"], 5).count() == 0


def test_items_of_one_id_add_up(spark):
    own = made(items(spark, [("a", "1", "cat dog"), ("a", "1", "cat"), ("a", "2", "dog")]))
    assert [r.item_id for r in index.top(own, ["cat"], 5).collect()] == ["1"]


def test_rare_words_of_a_bucket_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    """With more words there are more parts, so that a task's share does not grow; a word that stands in many items is dealt to all parts of its bucket."""
    docs = spark.range(3000).selectExpr("'document' as kind", "cast(id as string) as item_id", "concat_ws(' ', 'common', translate(cast(id as string), '0123456789', 'abcdefghij'), translate(cast(id + 7000 as string), '0123456789', 'klmnopqrst')) as body").repartition(6)
    share, most = {}, {}
    for per in (1_000_000, 50):
        monkeypatch.setattr(index, "PER_PART", per)
        made = index.build(docs, str(tmp_path / str(per)))
        found = spark.read.parquet(f"{made.path}/blocks").withColumn("file", F.input_file_name())
        share[per] = found.groupBy("bucket").agg(F.count_distinct("file").alias("n")).agg(F.min("n")).first()[0]
        most[per] = found.groupBy("file").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        assert found.agg(F.sum("n")).first()[0] == 9000
        assert [tuple(r) for r in index.top(made, ["common", "c"], 3).collect()] == [tuple(r) for r in explore.bm25(docs, ["common", "c"], 3).collect()]
    assert share[1_000_000] >= 4 and share[50] >= 12 and most[50] < most[1_000_000]
