"""Places of words and passages against plain Python, on awkward texts."""

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from vellumine.operators import explore, quotes

ITEMS = "kind string, item_id string, body string, w string, spans string, p int, rank int, hits int"


def items(spark, rows):
    """Extra columns with names that the operators use within."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], ITEMS)


def runs(text):
    """(start, stop) of the runs of letters, 1-based."""
    found, at = [], None
    for i, c in enumerate([*(text or ""), " "]):
        letter = unicodedata.category(c)[0] == "L"
        if letter and at is None:
            at = i
        elif not letter and at is not None:
            found.append((at + 1, i + 1))
            at = None
    return found


def awkward(rng, n):
    letters = list("abÉßİx 𝒳𝄞.,9'\n\té中́ ")
    return ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(n)] + [None, "", " ", "a", "one two", "x" * 50_000, "word, " * 20_000, "\n" * 1000 + "z"]


def test_token_spans_are_the_runs_of_letters_of_the_text(spark):
    texts = awkward(np.random.default_rng(1), 300)
    got = {}
    for r in quotes.token_spans(items(spark, [("a", str(i), t) for i, t in enumerate(texts)])).collect():
        got.setdefault(int(r.item_id), []).append((r.pos, r.start, r.stop, r.w))
    for i, text in enumerate(texts):
        own = sorted(got.get(i, []))
        assert [(s, e) for _, s, e, _ in own] == runs(text)
        assert [p for p, *_ in own] == list(range(1, len(own) + 1))
        assert all(text[s - 1 : e - 1].lower() == w for _, s, e, w in own)


def test_search_quotes_quotes_the_text_itself(spark):
    rows = [("a", "1", "The end. Then, the--THE cat"), ("a", "2", "the"), ("a", "3", "cat (the)"), ("a", "4", None), ("a", "5", "none"), ("b", "1", "the"), ("b", "1", "the"), ("b", "2", "")]
    df = items(spark, rows)
    got = quotes.search_quotes(df, ["the", "cat"], 2).collect()
    assert {(r.kind, r.item_id, r["rank"]) for r in got} == {("a", "1", 1), ("a", "3", 2), ("b", "1", 1), ("b", "1", 2)}
    first = sorted((r.pos, r.quote, r.start, r.stop, r.context_start, r.context) for r in got if (r.kind, r.item_id) == ("a", "1"))
    assert first == [(1, "The", 1, 4, 1, "The end. Then"), (4, "the", 16, 19, 5, "end. Then, the--THE cat"), (5, "THE", 21, 24, 10, "Then, the--THE cat"), (6, "cat", 25, 28, 16, "the--THE cat")]
    assert quotes.search_quotes(df.limit(0), ["the"], 2).count() == 0 and quotes.search_quotes(df, ["dog"], 2).count() == 0
    best = {(r.kind, r.item_id) for r in explore.search(df, ["the", "cat"], 2).collect()}
    assert best == {(r.kind, r.item_id) for r in got}


DOCS = "doc_id long, text string, item_id int, pos string, len int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], DOCS)


def passages_of(spark, rows):
    return spark.createDataFrame([(*r, 9, "p") for r in rows], "item_id long, text string, doc_id int, pos string")


def brute(docs, passages, first=False):
    found = []
    for d, text in docs:
        for i, p in passages:
            if d is None or i is None or not text or not p:
                continue
            at = [k + 1 for k in range(len(text) - len(p) + 1) if text.startswith(p, k)]
            found += [(d, i, k, len(p)) for k in (at[:1] if first else at)]
    return sorted(found)


def test_places_against_every_place(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("ab 𝄞é"), n))
    docs = [(i, text(rng.integers(0, 60))) for i in range(80)] + [(3, "aaaa"), (3, "aaaa"), (None, "aaaa"), (90, None), (91, ""), (92, "a" * 3000)]
    passages = [(i, text(rng.integers(0, 5))) for i in range(40)] + [(50, "aa"), (51, "aa"), (51, "aa"), (52, None), (None, "aa"), (53, "aaa"), (54, "𝄞")]
    d, p = docs_of(spark, docs), passages_of(spark, passages)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(quotes.places(d, p)) == brute(docs, passages)
    assert rows(quotes.places(d, p, first=True)) == brute(docs, passages, True)
    assert rows(quotes.places(d, p, most=8)) == brute(docs, passages)  # many automatons
    assert quotes.places(d.limit(0), p).count() == 0 and quotes.places(d, p.limit(0)).count() == 0


def test_evidence_by_automatons_and_by_joins(spark):
    rng = np.random.default_rng(3)
    words = ["be", "to", "on", "us", "it"]
    prose = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, prose(rng.integers(0, 40))) for i in range(60)] + [(7, "to be on"), (7, "to be on"), (61, None)]
    passages = [(i, prose(rng.integers(1, 6))) for i in range(30)] + [(40, "be"), (40, "o be o"), (41, "t"), (42, "to be on"), (42, "to be on")]
    d, p = docs_of(spark, docs), passages_of(spark, passages)
    want = brute(docs, passages, True)
    assert sorted(map(tuple, explore.evidence(d, p).collect())) == want
    assert sorted(map(tuple, explore.evidence(d, p, most=0).collect())) == want


def test_places_plan_has_no_join_and_no_shuffle(spark):
    plan = quotes.places(docs_of(spark, [(1, "a b")]), passages_of(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_word_spans_of_a_column(spark):
    from vellumine.functions.text import word_spans

    rows = spark.createDataFrame([(1, "Ab c"), (2, None)], "id int, body string").select("id", F.to_json(word_spans(F.col("body"))).alias("s")).collect()
    assert {r.id: r.s for r in rows} == {1: '[{"w":"ab","start":1,"stop":3},{"w":"c","start":4,"stop":5}]', 2: "[]"}
