"""Leaves of JSON, questions with their answers, and stored sketches, against plain Python."""

import json
from collections import Counter

import numpy as np
import pytest

from vellumine.operators import pairs, sketches, variants

# --- leaves of JSON -----------------------------------------------------------------------------------------------


def plain_leaves(value, path="$"):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            quoted = k.replace("\\", "\\\\").replace('"', '\\"')
            yield from plain_leaves(v, f"{path}.{k}" if k.isidentifier() and k.isascii() else f'{path}["{quoted}"]')
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from plain_leaves(v, f"{path}[{i}]")
    else:
        kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
        kind = kinds.get(type(value), "number")
        yield path, kind, None if value is None else value if kind == "string" else json.dumps(value, separators=(",", ":"))


def random_json(rng, depth=0):
    kind = int(rng.integers(0, 8 if depth < 5 else 5))
    if kind >= 5:
        n = int(rng.integers(0, 4))
        keys = rng.permutation(["a", "b_1", "ü", "a.b", 'q"', "\\", "", "x y"])[:n]
        return [random_json(rng, depth + 1) for _ in range(n)] if kind == 5 else {str(k): random_json(rng, depth + 1) for k in keys}
    return [None, True, int(rng.integers(-9, 1 << 40)), "é\n\"x", ""][kind]


def test_leaves_against_plain_python(spark):
    rng = np.random.default_rng(5)
    values = [random_json(rng) for _ in range(150)] + [[], {}, "x", 7, None, [[[]]], {"a": {"b": {"c": [1, {"d": None}]}}}]
    rows = [(i, json.dumps(v), "k") for i, v in enumerate(values)]
    got = variants.leaves(spark.createDataFrame(rows + rows[:5], "id long, body string, text string"), "body", "id", "text").collect()
    want = Counter((i, *x) for i, v in [*enumerate(values), *enumerate(values[:5])] for x in plain_leaves(v))
    assert Counter((r["id"], r["path"], r["type"], r["value"]) for r in got) == want


def test_leaves_are_told_once(spark):
    """What is returned reads written levels alone: no text is parsed again, and no variant's type is told again."""
    df = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": {}, "d": []}'), (2, "5"), (3, "{"), (4, "[null]"), (5, None)], "id long, body string")
    found = variants.leaves(df, "body", "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "schema_of_variant" not in plan and "variantexplode" not in plan.lower()
    assert {tuple(r) for r in found.collect()} == {(1, "$.a[0]", "number", "1"), (1, "$.a[1].b", "null", None), (1, "$.c", "object", "{}"), (1, "$.d", "array", "[]"), (2, "$", "number", "5"), (3, None, "malformed", "{"), (4, "$[0]", "null", None)}


def test_leaves_of_awkward_rows(spark):
    deep = "[" * 24 + "1" + "]" * 24
    bad = ['{"a":', "", "{'a':1}x", '{"a":1,"a":2}']
    df = spark.createDataFrame([(1, None), (2, '"' + "é" * 200_000 + '"'), (3, deep), *((10 + i, b) for i, b in enumerate(bad))], "id long, body string")
    got = {}
    for r in variants.leaves(df, "body", "id").collect():
        got.setdefault(r["id"], []).append((r["path"], r["type"], r["value"]))
    assert got.pop(2) == [("$", "string", "é" * 200_000)] and got.pop(3) == [("$" + "[0]" * 24, "number", "1")]
    assert got == {10 + i: [(None, "malformed", b)] for i, b in enumerate(bad)}
    assert variants.leaves(df.limit(0), "body", "id").count() == 0
    assert variants.leaves(df.where("id = 3"), "body").columns == ["path", "type", "value"]


def test_shape_of_unlike_rows(spark):
    rows = [("a", '{"k":1}'), ("a", '{"k":2.5,"m":"x"}'), ("a", "{"), ("a", None), ("b", '{"k":1}'), ("b", '{"k":[1]}'), (None, "3"), ("c", "{")]
    got = {r["g"]: (r["n"], r["malformed"], r["shape"]) for r in variants.shape(spark.createDataFrame(rows, "g string, j string"), "j", "g").collect()}
    assert got["a"][:2] == (3, 1) and "m: STRING" in got["a"][2] and "DECIMAL" in got["a"][2]
    assert got["b"] == (2, 0, "OBJECT<k: VARIANT>") and got[None] == (1, 0, "BIGINT") and got["c"][:2] == (1, 1)


# --- questions and answers ----------------------------------------------------------------------------------------


def plain_answers(rows):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for key, turns in groups.items():
        asked = None
        for _, turn, role, text in sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
            if role == "user":
                asked = (turn, text)
            elif role == "assistant":
                if asked:
                    out.append((key, asked[0], turn, asked[1], text))
                asked = None
    return Counter(out)


def test_answers_against_plain_python(spark):
    rng = np.random.default_rng(8)
    roles, texts = ["user", "assistant", "system", None, "user", "assistant"], ["a", "b", "", None, "é"]
    rows = [(None if k == 5 else f"c{k}", None if t == 9 else int(t), roles[r], texts[x]) for k, t, r, x in zip(rng.integers(0, 12, 400), rng.integers(0, 10, 400), rng.integers(0, 6, 400), rng.integers(0, 5, 400), strict=True)]
    df = spark.createDataFrame([(*r, "extra", "q") for r in rows], "conv string, at long, role string, text string, question string, row string")
    got = pairs.answers(df, "conv", "at")
    assert got.dtypes == [("conv", "string"), ("question_at", "bigint"), ("answer_at", "bigint"), ("question", "string"), ("answer", "string")]
    assert Counter(map(tuple, got.collect())) == plain_answers(rows)
    assert pairs.answers(df.limit(0), "conv", "at").count() == 0


def test_answers_keep_the_types_of_the_table(spark):
    df = spark.sql("select struct(1 as a, 'x' as b) as `the key`, date'2024-01-01' + id as `order by`, if(id % 2 = 0, 'user', 'assistant') as role, cast(id as string) as text from range(4)".replace("+ id", "+ cast(id as int)"))
    got = pairs.answers(df, "the key", "order by")
    assert [t for _, t in got.dtypes] == ["struct<a:int,b:string>", "date", "date", "string", "string"]
    assert sorted((r["question"], r["answer"]) for r in got.collect()) == [("0", "1"), ("2", "3")]


def test_answers_say_what_is_wrong(spark):
    df = spark.createDataFrame([(1, 1, "user")], "conv long, at long, role string")
    pairs.register(spark)
    df.createOrReplaceTempView("turns_without_text")
    with pytest.raises(Exception, match="no column text"):
        spark.sql("select * from answers(table(turns_without_text), 'conv', 'at')").collect()
    with pytest.raises(Exception, match="must be a table"):
        spark.sql("select * from answers(1, 'conv', 'at')").collect()


# --- sketches -----------------------------------------------------------------------------------------------------


def test_audience_is_exact_for_any_number_of_items(spark, tmp_path):
    """More users than a theta sketch holds exactly; nulls and other kinds are left out, rows of an item on several days count once."""
    many = spark.range(120_000).selectExpr("id % 5 as day", "if(id < 80000, 'click', 'purchase') as kind", "if(id < 80000, id, id - 40000) as user")
    more = many.unionByName(many.selectExpr("day + 1", "kind", "user").toDF("day", "kind", "user")).unionByName(spark.sql("select 9L as day, 'view' as kind, 7L as user union all select 1L, 'click', null union all select 1L, null, 3L"))
    assert tuple(sketches.audience_exact(sketches.item_sets(more, "user", "day", "kind"), "user", "kind", "click", "purchase").first()) == (80_000, 40_000, 40_000, 40_000)
    assert tuple(sketches.audience_exact(sketches.item_sets(more.limit(0), "user", "day", "kind"), "user", "kind", "click", "purchase").first()) == (0, 0, 0, 0)


def test_audience_query_with_more_users_than_a_sketch_holds(spark, tmp_path):
    import duckdb

    from vellumine.plans import registry

    rows = spark.range(60_000).selectExpr("id as event_id", "timestampadd(MINUTE, cast(id % 43000 as int), timestamp_ntz'2024-01-01 00:00:00') as ts", "nullif(id % 9001, 5) as user_id", "if(id % 7 < 4, 'click', 'purchase') as event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["audience"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["audience"](spark, str(tmp_path)).collect())) == sorted(want)


def test_audience_of_stored_sketches(spark):
    """Exact while a sketch holds all items, near beyond; merged over days, nulls left out."""
    rows = [(d, kind, u) for d in range(4) for kind, lo, hi in (("click", 0, 600), ("purchase", 400 + 50 * d, 900)) for u in range(lo, hi, 1 + d)] + [(0, "click", None), (None, None, 5)]
    df = spark.createDataFrame(rows, "day int, kind string, user long")
    users = lambda kind: {u for _, k, u in rows if k == kind and u is not None}
    a, b = users("click"), users("purchase")
    assert [tuple(r) for r in sketches.audience(sketches.set_sketches(df, "user", "day", "kind"), "kind", "click", "purchase").collect()] == [(len(a), len(b), len(a & b), len(a - b))]
    many = spark.range(120_000).selectExpr("id % 5 as day", "if(id < 80000, 'click', 'purchase') as kind", "if(id < 80000, id, id - 40000) as user")
    got = sketches.audience(sketches.set_sketches(many, "user", "day", "kind"), "kind", "click", "purchase").first()
    assert [abs(got[c] - n) < 0.1 * n for c, n in (("has", 80_000), ("lacks", 40_000), ("only", 40_000))] == [True] * 3
    missing = sketches.audience(sketches.set_sketches(df.where("kind = 'click'"), "user", "day", "kind"), "kind", "click", "purchase").first()
    assert tuple(missing) == (len(a), 0, 0, len(a))
    assert tuple(sketches.audience(sketches.set_sketches(df.limit(0), "user", "day", "kind"), "kind", "click", "purchase").first()) == (0, 0, 0, 0)
    assert sketches.audience(sketches.set_sketches(df.limit(0), "user", "day", "kind"), "kind", "click", "purchase", "day").count() == 0


def test_count_min_is_never_low_and_seldom_high(spark):
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.zipf(1.3, 20_000) % 5000]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "at long")
    half = [sketches.count_min(part, "at", 1e-3, 0.01) for part in (df.where("at % 2 = 0"), df.where("at % 2 = 1"))]
    whole = sketches.count_min(df, "at", 1e-3, 0.01)
    assert sorted(map(tuple, sketches.merge(half[0].unionByName(half[1])).collect())) == sorted(map(tuple, whole.collect()))
    width, depth = sketches.shape_for(1e-3, 0.01)
    assert whole.count() <= width * depth
    exact = Counter(values)
    asked = spark.createDataFrame([(v, "x") for v in [*exact, 9_999, None]], "at long, about string").withColumnRenamed("about", "n")
    got = {r["at"]: r["about"] for r in sketches.counts(whole, asked, "at", 1e-3, 0.01).collect()}
    assert len(got) == len(exact) + 2 and got[None] == 0
    assert all(got[v] >= n for v, n in exact.items())
    assert sum(got[v] > n + 1e-3 * len(values) for v, n in exact.items()) <= 0.01 * len(exact) + 1


def test_frequent_items_of_stored_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), int(x)) for d, x in zip(rng.integers(0, 5, 8000), rng.zipf(1.5, 8000) % 3000, strict=True)]
    df = spark.createDataFrame(rows + [(None, 7)] * 3 + [(1, None)], "day int, item long")
    parts = sketches.frequent_parts(df, "item", "day")
    exact = Counter(x for _, x in rows)
    exact[7] += 3
    got = sketches.frequent(parts, 5).collect()
    assert [r["n"] for r in got] == sorted(exact.values(), reverse=True)[:5] and all(exact[r["item"]] == r["n"] for r in got)
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    assert {r["day"] for r in sketches.frequent(parts, 1, "day").collect()} == {0, 1, 2, 3, 4, None}
    assert sketches.frequent(sketches.frequent_parts(df.limit(0), "item", "day"), 5, "day").count() == 0
