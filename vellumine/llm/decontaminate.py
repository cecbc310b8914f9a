"""Benchmark decontamination by template windows.

Texts become templates: words in lower case, numbers, names (capitalised within a sentence) and units (after a number) as
typed placeholders, of which neighbours of one type count as one. Windows of WINDOW template tokens with LITERAL words at least are joined by
hash with those of the benchmark's items. Matches of one item at one displacement are an alignment; its slots must be
consistent: each value of the item stands for one value in the document, and the reverse. A document is reported with an
item if consistent alignments cover LEAST of the item's windows, or if one with equal values covers RUN template tokens without a gap: a verbatim part of a longer item.
So copies are found, parts of them, and questions asked again with other numbers or names.

An item without a window (fewer than WINDOW template tokens, or hardly a literal one) is matched whole, by its exact sequence of words and numbers, of which it must have `shortest`. `matches` reports items of one word too, wherever
the word stands; `clean` asks for SHORTEST, as a document that holds a word or two of everyday language is not contaminated by it. LEAST, RUN and SHORTEST are defaults of parameters.

Documents' windows are filtered by a sorted table of the items' hashes where those number BROADCAST at most; beyond it all windows go to the join, in which a crowded hash is dealt to several tasks.

Cases: null or empty texts, items of no word or fewer than `shortest`: matched with nothing. Rows with the same id count as
one document, and as one item. Null ids are not reported. Very long texts are read whole. An item that stands in a document several times counts once, with its best share.
Empty tables: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.joins import BROADCAST_IDS, beside, unused
from vellumine.llm.textnum import LOWER, U, hashes, mix, spans, texts
from vellumine.plans.scratch import Scratch, ship

WINDOW, LITERAL, LEAST, RUN, SHORTEST, BROADCAST = 5, 2, 0.8, 8, 3, 500_000
#: Names of units, in four languages.
UNITS = """
% percent km m cm mm mi mile miles meter meters metre metres foot feet inch inches yard yards kilometer kilometers kilometre kilometres
kg g mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes l ml liter liters litre litres gallon gallons
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars cent cents euro euros usd eur gbp degree degrees celsius fahrenheit kmh mph watt watts kw volt volts joule joules hertz hz
prozent stunde stunden minute minuten sekunde sekunden tag tage woche wochen monat monate jahr jahre
heure heures jour jours semaine semaines mois an ans hora horas segundo segundos dia dias semana semanas mes meses
""".split()
_IN = np.zeros(256, bool)
_IN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100), ord("%")]] = True
_DIGIT, _JOIN, _STOP, _UPPER = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58], _JOIN[[ord("."), ord(",")]], _UPPER[65:91] = True, True, True
_STOP[[ord(c) for c in ".!?:\n\r\"“”|>#*-"if ord(c) < 128]] = True


def _hash_of(names: list[str]) -> np.ndarray:
    out = []
    for name in names:
        data = np.frombuffer(name.encode(), np.uint8)
        out.append(hashes(data, np.array([0]), np.array([len(data)]))[0])
    return np.unique(np.array(out, U))


_UNIT = _hash_of(UNITS)
_PLACE = np.array([0, 0x11, 0x22, 0x33], U)  # literal, number, name, unit


def template(data: np.ndarray, off: np.ndarray):
    """Hashes of the template tokens, their kinds (0 literal, 1 number, 2 name, 3 unit), their values, and the first of each text; all tokens' values and the first of each text."""
    inside = _IN[data]
    digit, n = _DIGIT[data], len(data)
    if n > 2:  # signs within a number
        inside[1:-1] |= _JOIN[data[1:-1]] & digit[:-2] & digit[2:]
    starts, ends, first = spans(inside, off)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int8), np.zeros(0, U), first, np.zeros(0, U), first
    value = hashes(LOWER[data], starts, ends)
    total = np.concatenate([[0], np.cumsum(digit | _JOIN[data])])
    number = (total[ends] - total[starts] == ends - starts) & digit[starts]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    begins = np.ones(len(starts), bool)
    begins[1:] = stops[starts[1:]] > stops[ends[:-1]]
    begins[first[:-1][first[:-1] < len(starts)]] = True
    upper = _UPPER[data[starts]]
    after = np.minimum(starts + 1, n - 1)  # capitals of two-byte Latin letters
    upper |= (data[starts] == 0xC3) & (data[after] >= 0x80) & (data[after] <= 0x9E)
    kind = np.zeros(len(starts), np.int8)
    kind[upper & ~begins] = 2
    kind[number] = 1
    at = np.searchsorted(_UNIT, value)
    unit = _UNIT[np.minimum(at, len(_UNIT) - 1)] == value
    same = np.zeros(len(starts), bool)  # in one text with the token before
    same[1:] = True
    same[first[:-1][first[:-1] < len(starts)]] = False
    unit[1:] &= number[:-1]
    unit[0] = False
    kind[unit & same] = 3
    token = np.where(kind == 0, value, _PLACE[kind])
    drop = np.zeros(len(starts), bool)
    drop[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & same[1:]
    group = np.cumsum(~drop) - 1
    merged = value[~drop].copy()
    np.add.at(merged, group[drop], mix(value[drop]))  # a run of names is one value
    return token[~drop], kind[~drop], merged, np.searchsorted(np.flatnonzero(~drop), first), value, first


def windows(token, kind, value, first):
    """Index of the text, place, hash, and the positions of the slots' values."""
    n = max(0, len(token) - WINDOW + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h, literal = np.zeros(n, U), np.zeros(n, np.int64)
    for i in range(WINDOW if n else 0):
        h = h * U(0xFF51AFD7ED558CCD) + token[i : i + n]
        literal += kind[i : i + n] == 0
    good = (literal >= LITERAL) & (doc[:n] == doc[WINDOW - 1 :]) if n else np.zeros(0, bool)
    at = np.flatnonzero(good)
    return doc[at], at - first[doc[at]], mix(h[at]).view(np.int64), at


def sequences(value, first, m):
    """Index of the text and hash of each run of m tokens."""
    n = max(0, len(value) - m + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    power = np.concatenate([[U(1)], np.cumprod(np.full(m, 0xFF51AFD7ED558CCD, U), dtype=U)])
    h = np.zeros(n, U)
    for i in range(m if n else 0):
        h = h + value[i : i + n] * power[m - 1 - i]
    good = np.flatnonzero(doc[:n] == doc[m - 1 :]) if n else np.zeros(0, np.int64)
    return doc[good], good - first[doc[good]], mix(h[good] ^ U(m)).view(np.int64)


SHAPE = "id long, pos long, h long, m long, slots array<long>, n long"


def make_windows(wanted=None, lengths: tuple[int, ...] | None = (), shortest: int = 1):
    """Rows of SHAPE; wanted: a broadcast sorted array of hashes, or None for all. m is 0 for windows, whose slots are the values at their placeholders. lengths: also runs of so
    many tokens, with m; None: of texts without a window alone, as one run of all their tokens, `shortest` or more. A run that a text repeats is given once."""

    def run(batches):
        few, bits = None, None
        if wanted is not None:
            few = wanted.value
            bits = np.zeros(1 << 22, bool)
            bits[few & ((1 << 22) - 1)] = True

        def rows(ids, doc, pos, h, m, slots, n):
            return pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(pos.astype(np.int64)), pa.array(h), pa.array(np.full(len(h), m, np.int64)), slots, pa.array(n)], ["id", "pos", "h", "m", "slots", "n"])

        def asked(h):
            if few is None:
                return np.arange(len(h))
            hit = np.flatnonzero(bits[h & ((1 << 22) - 1)])
            return hit[few[np.minimum(np.searchsorted(few, h[hit]), len(few) - 1)] == h[hit]] if len(few) else hit[:0]

        for b in batches:
            ids = np.asarray(b.column(0).cast(pa.int64()).fill_null(-1))
            for lo, _, data, off in texts(b.column(1), 1 << 18):
                token, kind, value, first, word, of = template(data, off)
                doc, pos, h, at = windows(token, kind, value, first)
                count = np.bincount(doc, minlength=len(off) - 1)
                if lengths is None:
                    sizes = np.diff(of)
                    alone = np.flatnonzero((count == 0) & (sizes >= max(1, shortest)))
                    for m in np.unique(sizes[alone]).tolist():
                        d, p, run_ = sequences(word, of, m)
                        mine = np.isin(d, alone[sizes[alone] == m])
                        yield rows(ids, lo + d[mine], p[mine], run_[mine], m, pa.array([[]] * int(mine.sum()), pa.list_(pa.int64())), np.ones(int(mine.sum()), np.int64))
                for m in lengths or ():
                    d, p, run_ = sequences(word, of, m)
                    hit = asked(run_)
                    hit = hit[np.unique(np.stack([d[hit], run_[hit]]), axis=1, return_index=True)[1]]
                    yield rows(ids, lo + d[hit], p[hit], run_[hit], m, pa.array([[]] * len(hit), pa.list_(pa.int64())), np.ones(len(hit), np.int64))
                hit = asked(h)
                doc, pos, h, at = doc[hit], pos[hit], h[hit], at[hit]
                for i in range(0, len(doc), 50_000):
                    part = slice(i, i + 50_000)
                    spots = at[part, None] + np.arange(WINDOW)
                    held = kind[spots] > 0
                    ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
                    slots = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[spots][held].view(np.int64)))
                    yield rows(ids, lo + doc[part], pos[part], h[part], 0, slots, count[doc[part]])

    return run


def covered(at: F.Column) -> F.Column:
    """The most template tokens that windows at these places cover without a gap."""
    none = F.struct(F.lit(-WINDOW - 1).cast("long").alias("last"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("best"))

    def step(s, x):
        start = F.when(x - s["last"] <= WINDOW, s["start"]).otherwise(x)
        return F.struct(x.alias("last"), start.alias("start"), F.greatest(s["best"], x + WINDOW - start).alias("best"))

    return F.aggregate(F.array_sort(at), none, step, lambda s: s["best"])


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", least: float = LEAST, run: int = RUN, shortest: int = 1) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage, same_values of each contaminated document and item: a share of `least` of the item's windows, or `run` template tokens of it word for word, or all of an item without windows that has `shortest` words."""
    scratch = Scratch(spark, "decontaminate")
    slim = lambda df, i: df.where(F.col(i).isNotNull()).select(F.col(i).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = scratch.write(slim(items, item_id).mapInArrow(make_windows(None, None, shortest), SHAPE), "items")
    lengths = tuple(sorted(r[0] for r in known.where("m > 0").select("m").distinct().collect()))  # a few numbers
    wanted, rows = None, known.count()
    if rows <= BROADCAST:
        wanted = spark.sparkContext.broadcast(np.unique(np.asarray(known.select("h").toArrow()["h"], np.int64)))
    found = slim(docs, doc_id).mapInArrow(make_windows(wanted, lengths), SHAPE).select("id", "pos", "h", "m", "slots")
    known = known.select("h", "m", F.col("id").alias("item"), F.col("pos").alias("at"), F.col("slots").alias("of"), F.col("n").alias("windows"))
    met = beside(found, known, ["h", "m"], rows, "inner", BROADCAST).select("id", "item", "windows", "at", (F.col("pos") - F.col("at")).alias("shift"), F.arrays_zip("of", "slots").alias("slots"))
    # one alignment has at most as many rows as its item has windows
    aligned = met.groupBy("id", "item", "windows", "shift").agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    one = lambda side: F.size(F.array_distinct(F.transform("slots", lambda s: s[side])))
    good = aligned.where((F.size("slots") == one("of")) & (F.size("slots") == one("slots")))
    equal = F.forall("slots", lambda s: s["of"] == s["slots"])
    placed = good.select("id", "item", "windows", equal.alias("equal"), F.when(equal, covered(F.col("at"))).otherwise(0).alias("run"), F.explode("at").alias("at"))
    placed = placed.groupBy("id", "item", "windows", "at").agg(F.max("equal").alias("equal"), F.max("run").alias("run"))
    done = placed.groupBy("id", "item", "windows").agg(F.count("*").alias("n_matched"), F.min("equal").alias("same_values"), F.max("run").alias("run"))
    share = F.col("n_matched") / F.col("windows")
    done = done.where((share >= least) | (F.col("run") >= run)).select(F.col("id").alias(doc_id), F.col("item").alias(item_id), F.col("windows").alias("n_windows"), "n_matched", share.alias("coverage"), "same_values")
    best = F.max_by(F.struct("n_windows", "n_matched", "coverage", "same_values"), F.struct("coverage", "n_windows", "same_values"))
    return done.groupBy(doc_id, item_id).agg(best.alias("best")).select(doc_id, item_id, "best.*")


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", least: float = LEAST, run: int = RUN, shortest: int = SHORTEST) -> DataFrame:
    """docs without the contaminated ones. Rows with a null id stay."""
    name = unused(docs, "bad")
    bad = Scratch(spark, "clean").write(matches(spark, docs, items, doc_id, text_col=text_col, least=least, run=run, shortest=shortest).select(F.col(doc_id).alias(name)).distinct(), "bad")
    few = F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad
    return docs.join(few, docs[doc_id].cast("long") == F.col(name), "left_anti")
