"""Column functions over words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}+"


def words(body: Column) -> Column:
    """Runs of letters in lower case; of null, none."""
    return F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit(WORD), F.lit(0))


def snippet(tokens: Column, at: Column, before: int = 2, length: int = 5) -> Column:
    """Tokens around a 1-based position."""
    return F.array_join(F.slice(tokens, F.greatest(at - before, F.lit(1)), length), " ")


def json_value(props: Column, path: str) -> Column:
    return F.get_json_object(props, path)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null of a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


#: Pieces in a block of running sums: sums within a block and over blocks are short, so a text of n pieces costs about n * BLOCK / 2 additions.
BLOCK = 24


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(numbers: Column) -> Column:
    """For each number the sum of those before it; for short arrays."""
    return _let(numbers, lambda own: F.transform(own, lambda _, i: F.aggregate(F.slice(own, 1, i), F.lit(0).cast("long"), lambda s, x: s + x)))


def word_spans(body: Column) -> Column:
    """Array of (w, start, stop): the runs of letters of the text as it stands, each in lower case, from its 1-based start up to before stop, in characters, so that
    substr(body, start, stop - start) is the run. Null has none. Runs are those of the text itself: a letter whose lower case is a letter and a mark does not end one, as it does in words()."""
    pieces = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))  # together the whole text

    def placed(block: Column, before: Column) -> Column:
        sums = _running(F.transform(block, lambda p: F.length(p).cast("long")))
        return F.zip_with(block, sums, lambda p, s: F.struct(p.alias("p"), (before + s + 1).alias("start")))

    def all_blocks(p: Column) -> Column:
        blocks = F.transform(F.when(F.size(p) > 0, F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, _running(F.transform(b, lambda x: F.length(F.array_join(x, "")).cast("long"))), placed)))

    spans = F.filter(_let(pieces, all_blocks), lambda x: x["p"].rlike(r"^\p{L}"))
    return F.transform(spans, lambda x: F.struct(F.lower(x["p"]).alias("w"), x["start"].alias("start"), (x["start"] + F.length(x["p"])).alias("stop")))
