"""Quality rules with DataFrame functions alone: base rules, then divergence from the histograms of known languages.

A document's histogram of character classes and that of common words are compared with each language's reference by
Jensen-Shannon distance (logarithms to base 2). References are fixed public frequencies (CLASS_SHARES, WORD_SHARES), so the verdict on a
document depends on that document alone: no pass over the table, no shuffle, and junk in a table moves no reference.
The verdict rejects a document whose nearest reference is farther than FAR on the mean of both. Guards: a histogram of fewer than
LEAST_WORDS words or LEAST_CHARS characters is left out of the mean (distance 0 where both are).

Cases: null and empty texts: all counts 0, base_failed, divergence null. Repeated rows are judged each. A document whose language is null or has no
reference: its common words and its letters are not compared; its classes are, with all letters as one class, to the nearest reference.
No references at all: the base rules decide. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAR, LEAST_WORDS, LEAST_CHARS, WINDOW = 0.22, 50, 200, 8
#: The ten commonest words of each language, and how many of 1,000 words of running text each is, in round numbers.
WORD_SHARES = {
    "de": "der 35 die 35 und 30 in 20 den 13 von 11 zu 11 das 11 mit 9 sich 8",
    "en": "the 60 of 30 and 28 to 25 in 20 a 20 is 10 that 10 for 9 it 9",
    "es": "de 62 la 38 que 30 el 29 en 26 y 26 a 20 los 17 se 13 del 11",
    "fr": "de 57 la 30 et 25 le 24 les 20 des 18 en 15 un 12 du 12 une 11",
}
#: How many of 100 characters of running text are of each of CLASSES, in round numbers.
CLASSES = ("space", "digit", "upper", "stop", "symbol", "wide", "other")
CLASS_SHARES = {
    "de": (15, 1, 6, 2.5, 0.1, 2, 73.4),
    "en": (17, 1, 2.5, 2.5, 0.1, 0.1, 76.8),
    "es": (17, 1, 2.5, 2.5, 0.1, 4, 72.9),
    "fr": (17, 1, 2.5, 3, 0.1, 6, 70.4),
}
#: What a language's reference has of another's common word, of 1,000 words.
STRAY = 0.5
SHARES = {lang: dict(zip(text.split()[::2], map(float, text.split()[1::2]), strict=True)) for lang, text in WORD_SHARES.items()}
WORDS = sorted({w for one in SHARES.values() for w in one})
_LETTERS = [chr(0x41 + i) for i in range(len(WORDS))]
APART = r"[\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """use(value), with value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def repeated(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more."""

    def of(win: Column) -> Column:
        order = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        at = let(order, lambda s: F.array_sort(F.transform(same(s), lambda x: x["i"])))
        covered = let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(win)) < F.size(win), covered).otherwise(F.lit(0).cast("long"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(F.size(words) > WINDOW, let(windows, of)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, lang, the base counts, classes array<long> and common array<long> (WORDS, then all other words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text"))
    words = F.array_remove(F.split("text", APART), "")
    known = F.create_map(*(F.lit(x) for pair in zip(WORDS, _LETTERS, strict=True) for x in pair))

    def counts(w: Column) -> Column:
        short = F.filter(F.transform(F.filter(w, lambda x: F.octet_length(x) <= max(map(len, WORDS))), lambda x: F.lower(x)), lambda x: x.isin(WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated(w).alias("n_repeat_words"),
            F.array_join(F.transform(short, lambda x: F.element_at(known, x)), "").alias("letters"),
        )

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("id", "lang", let(words, counts).alias("c"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("digit"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("upper"), F.regexp_count("text", F.lit(r"[.,;:!?'\"()-]")).cast("long").alias("stop"))
    space = F.col("chars") - F.col("c.word_chars")
    wide = F.least(F.col("bytes") - F.col("chars"), F.col("chars"))
    rest = F.greatest(F.col("chars") - space - F.col("digit") - F.col("upper") - F.col("stop") - F.col("n_symbols") - wide, F.lit(0))
    each = [F.length("c.letters") - F.length(F.replace(F.col("c.letters"), F.lit(x), F.lit(""))) for x in _LETTERS]
    common = F.array(*(x.cast("long") for x in each), F.col("c.n_words") - F.length("c.letters"))
    return df.select("id", "lang", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", F.array(space, "digit", "upper", "stop", "n_symbols", wide, rest).alias("classes"), common.alias("common"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda t: F.when((t["p"] > 0) & (t["q"] > 0), F.zip_with(p, q, lambda x, y: let(F.struct((x / t["p"]).alias("x"), (y / t["q"]).alias("y")), lambda s: part(s["x"], (s["x"] + s["y"]) / 2) + part(s["y"], (s["x"] + s["y"]) / 2)))))
    return F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0)))


def references(languages: tuple[str, ...] | None = None) -> list[tuple[list[float], list[float], list[float]]]:
    """For each language: shares of classes, of common words (WORDS, then all others), and of classes with all letters as one."""
    out = []
    for lang in sorted(SHARES) if languages is None else languages:
        common = [SHARES[lang].get(w, 0.0) + STRAY for w in WORDS]
        shares = [float(x) for x in CLASS_SHARES[lang]]
        out.append((shares, [*common, 1000.0 - sum(common)], together(shares)))
    return out


def together(classes):
    """space, digit, stop, symbol, and letters of any kind."""
    space, digit, upper, stop, symbol, wide, other = classes
    return [space, digit, stop, symbol, upper + wide + other]


def judge(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: tuple[str, ...] | None = None) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, divergence of every row. languages: those whose references are used."""
    df = measured(docs, id_col, text_col, lang_col).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    fixed = lambda values: F.array(*map(F.lit, values))
    letters = F.array(*together([F.col("classes")[i] for i in range(len(CLASSES))]))
    near, other = [], []
    for shares, common, merged in references(languages):
        by_class = F.when(chars >= LEAST_CHARS, distance(F.col("classes"), fixed(shares)))
        by_word = F.when(F.col("n_words") >= LEAST_WORDS, distance(F.col("common"), fixed(common)))
        near.append(let(F.struct(by_class.alias("c"), by_word.alias("w")), lambda d: F.coalesce((d["c"] + d["w"]) / 2, d["c"], d["w"], F.lit(0.0))))
        other.append(F.coalesce(F.when(chars >= LEAST_CHARS, distance(letters, fixed(merged))), F.lit(0.0)))
    least = lambda found: F.array_min(F.array(*found)) if found else F.lit(None).cast("double")
    known = F.coalesce(F.col("lang").isin(sorted(SHARES) if languages is None else list(languages)), F.lit(False))
    df = df.withColumn("divergence", F.when(~F.col("base_failed"), F.when(known, least(near)).otherwise(least(other))))
    kept = ~F.col("base_failed") & (F.coalesce("divergence", F.lit(0.0)) <= FAR)
    return df.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "divergence")
