"""Language identification by Bayesian fusion of evidence.

The posterior of each language multiplies the likelihood of the text (runs of four bytes and whole words, naive Bayes, worth at most
EVIDENCE independent observations), that of the language which the markup declares, and a prior of the host.
Priors come from grouped sums of the text posteriors over all rows and are smoothed in a hierarchy: all rows, the
address suffix, the host, each level shrunk to the one above by STRENGTH rows, and without the row's own share.

The text model is fit on at most SAMPLE distinct texts of each labelled language, of at most SAMPLE_CHARS characters, those with the least
hashes, so a group of copies counts once; likelihoods and priors cover all rows. Host priors are broadcast up to BROADCAST_HOSTS hosts; beyond it each host is dealt to several tasks.

Cases: null or empty text: no text evidence, language null, kept false. No labels to fit on: the same for all rows. Null or
unknown declared languages, suffixes and hosts: no evidence of that kind. Repeated rows count each. Very long texts are read whole, as evidence of EVIDENCE observations. Ties go to the first language in order.
A row is kept if a language's posterior is at least LEAST.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.joins import beside
from vellumine.llm.textnum import LOWER, U, hashes, texts, words
from vellumine.plans.scratch import Scratch, sample_bound, ship

SAMPLE, SAMPLE_CHARS, SLOTS, EVIDENCE, STRENGTH, RELIABLE, LEAST = 200, 20_000, 1 << 16, 60, 20.0, 0.9, 0.5
BROADCAST_HOSTS = 100_000
#: A low letter code for digits and signs, so that they say nothing of a language.
PLAIN = LOWER.copy()
PLAIN[[b for b in range(0x21, 0x7F) if not chr(b).isalpha()]] = 0x20
PLAIN[[*range(0x09, 0x0E)]] = 0x20


def observed(data: np.ndarray, off: np.ndarray):
    """Slots of the byte runs and of the words, the first of each text, with marks off the table for runs without a letter."""
    data = PLAIN[data]
    d = data.astype(np.uint32)
    n = max(0, len(d) - 3)
    run = d[:n] | d[1 : n + 1] << np.uint32(8) | d[2 : n + 2] << np.uint32(16) | d[3 : n + 3] << np.uint32(24)
    slot = ((run * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    good = (run != np.uint32(0x20202020)) & (text[:n] == text[3:])
    starts, stops, first = words(data, off)
    word = (hashes(data, starts, stops) % U(SLOTS)).astype(np.int64) + SLOTS
    return slot[good], np.searchsorted(np.flatnonzero(good), off), word, first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


class Model:
    """languages in order and, for each slot, the log probability in each less the mean over them."""

    def __init__(self, languages: list[str], samples: list[list[str]]):
        self.languages = languages
        counts = np.zeros((2 * SLOTS, len(languages)))
        for i, sample in enumerate(samples):
            for _, _, data, off in texts(pa.array(sample, pa.string())):
                runs, _, word, _ = observed(data, off)
                counts[:, i] += np.bincount(np.concatenate([runs, word]), minlength=2 * SLOTS)
        logs = []
        for part in (counts[:SLOTS], counts[SLOTS:]):
            logs.append(np.log((part + 0.5) / (part.sum(axis=0) + 0.5 * SLOTS)))
        self.table = np.concatenate(logs)
        self.table = (self.table - self.table.mean(axis=1, keepdims=True)).astype(np.float32) if languages else self.table.astype(np.float32)

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods of each text, and its number of words."""
        out, count = [], []
        for lo, hi, data, off in texts(column, 1 << 18):
            runs, at, word, first = observed(data, off)
            total = sums(self.table[runs], at) + sums(self.table[word], first) if self.languages else np.zeros((hi - lo, 0))
            n = np.diff(at) + np.diff(first)
            out.append(total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None])
            count.append(np.diff(first))
        return (np.concatenate(out), np.concatenate(count)) if out else (np.zeros((0, len(self.languages))), np.zeros(0, np.int64))


def fit(spark: SparkSession, docs: DataFrame, text_col: str = "text", label_col: str = "lang", languages: tuple[str, ...] = ("de", "en", "es", "fr")) -> Model:
    fit_for = docs.where(F.col(label_col).isin(*languages) & (F.length(text_col) <= SAMPLE_CHARS)).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    turn = F.shiftrightunsigned(F.xxhash64("text", F.lit(5)), 1)
    fit_for = fit_for.withColumn("turn", turn)
    # at most a row for each language; a sketch, as copies must not count towards the bound
    counts = {r["label"]: r["n"] for r in fit_for.groupBy("label").agg(F.approx_count_distinct("turn", 0.02).alias("n")).collect()}
    below = F.lit(False)
    for one, count in counts.items():
        below = below | ((F.col("label") == one) & (F.col("turn") <= sample_bound(count, SAMPLE)))
    texts_ = fit_for.where(below).groupBy("label", "turn").agg(F.min("text").alias("text"))
    chosen = texts_.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("turn"))).where(F.col("nth") <= SAMPLE)
    rows = chosen.select("label", "turn", "text").orderBy("label", "turn").collect()  # at most SAMPLE rows of each language
    samples = [[r["text"] for r in rows if r["label"] == one] for one in languages]
    known = [(one, s) for one, s in zip(languages, samples, strict=True) if s]
    return Model([k for k, _ in known], [s for _, s in known])


def with_likelihoods(spark: SparkSession, df: DataFrame, model: Model, text_col: str, drop_text: bool) -> DataFrame:
    """df with __ll array<double> and __words."""
    ship(spark)
    shared, at = spark.sparkContext.broadcast(model), df.columns.index(text_col)
    keep = [i for i in range(len(df.columns)) if not (drop_text and i == at)]
    fields = [df.schema.fields[i] for i in keep]

    def run(batches):
        for b in batches:
            ll, n = shared.value.likelihoods(b.column(at))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ll) + 1) * ll.shape[1], pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), flat, pa.array(n.astype(np.int64))], [*(b.schema.names[i] for i in keep), "__ll", "__words"])

    schema = type(df.schema)(fields).add("__ll", T.ArrayType(T.DoubleType())).add("__words", T.LongType())
    return df.mapInArrow(run, schema)


def softmax(logs: Column) -> Column:
    """Probabilities of log weights; of none, null."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(F.array(raised), lambda r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, y: a + y)))[0]


def posterior(logs: Column, n: int) -> list[Column]:
    p = softmax(logs)
    return [F.get(p, i) for i in range(n)]


def _host(col: str | None) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")) if col else F.lit("")


def suffix_of(host: Column) -> Column:
    """The last label of a host that has several, else an empty string."""
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def priors(spark: SparkSession, likely: DataFrame, languages: list[str]) -> DataFrame:
    """For each host: its own sums, and the smoothed shares of its suffix. likely: __host, __ll, __words."""
    n = len(languages)
    p = F.array(*posterior(F.col("__ll"), n))
    shares = likely.where("__words > 0").select("__host", p.alias("p"))
    hosts = shares.groupBy("__host").agg(*(F.sum(F.col("p")[i]).alias(f"h{i}") for i in range(n)))
    hosts = hosts.withColumn("__suffix", suffix_of(F.col("__host")))
    suffixes = hosts.groupBy("__suffix").agg(*(F.sum(f"h{i}").alias(f"s{i}") for i in range(n)))
    whole = suffixes.agg(*(F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"g{i}") for i in range(n)))
    suffixes = suffixes.crossJoin(F.broadcast(whole))  # one row
    total_s, total_g = (sum((F.col(f"{c}{i}") for i in range(n)), F.lit(0.0)) for c in "sg")
    above = [(F.col(f"g{i}") + 1) / (total_g + n) for i in range(n)]
    at_suffix = [(F.col(f"s{i}") + STRENGTH * above[i]) / (total_s + STRENGTH) for i in range(n)]
    suffixes = suffixes.select("__suffix", *(a.alias(f"q{i}") for i, a in enumerate(at_suffix)))
    return hosts.join(suffixes, "__suffix").select("__host", F.array(*(f"h{i}" for i in range(n))).alias("__own"), F.array(*(f"q{i}" for i in range(n))).alias("__above"))


def decide(likely: DataFrame, prior: DataFrame, languages: list[str]) -> DataFrame:
    """likely with __posterior array<double>. likely: __host, __declared, __ll, __words."""
    n = len(languages)
    if not n:
        return likely.withColumn("__posterior", F.array().cast("array<double>"))
    df = beside(likely, prior, "__host", prior.count(), "left", BROADCAST_HOSTS)
    text = F.array(*posterior(F.col("__ll"), n))
    seen = F.col("__words") > 0
    mine = [F.when(seen, text[i]).otherwise(0.0) for i in range(n)]
    even = F.lit(1.0 / n)
    total = F.coalesce(F.aggregate("__own", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)) - F.when(seen, 1.0).otherwise(0.0)
    logs = []
    for i, one in enumerate(languages):
        held = F.greatest(F.coalesce(F.col("__own")[i], F.lit(0.0)) - mine[i], F.lit(0.0))
        prior_ = (held + STRENGTH * F.coalesce(F.col("__above")[i], even)) / (F.greatest(total, F.lit(0.0)) + STRENGTH)
        said = F.when(~F.col("__declared").isin(languages) | F.col("__declared").isNull(), 0.0).when(F.col("__declared") == one, float(np.log(RELIABLE))).otherwise(float(np.log((1 - RELIABLE) / max(1, n - 1))))
        logs.append(F.col("__ll")[i] + said + F.log(prior_))
    return df.withColumn("__posterior", softmax(F.array(*logs))).drop("__own", "__above")


def _verdict(df: DataFrame, languages: list[str]) -> tuple[Column, Column, Column]:
    best = F.array_max("__posterior")
    names = F.array(*map(F.lit, languages)) if languages else F.array().cast("array<string>")
    language = F.when(F.col("__words") > 0, F.get(names, F.array_position("__posterior", best).cast("int") - 1))
    return language, best, F.coalesce((F.col("__words") > 0) & (best >= LEAST), F.lit(False))


def identify(spark: SparkSession, df: DataFrame, model: Model, id_col: str, text_col: str = "text", host_col: str | None = None, declared_col: str | None = None) -> DataFrame:
    """id, language, confidence, n_words, kept of every row. host_col holds host names (or any name of the source)."""
    declared = F.lower(F.substring(F.col(declared_col).cast("string"), 1, 2)) if declared_col else F.lit(None).cast("string")
    own = df.select(F.col(id_col).alias("__id"), _host(host_col).alias("__host"), declared.alias("__declared"), F.col(text_col).alias("__text"))
    likely = Scratch(spark, "language").write(with_likelihoods(spark, own, model, "__text", True), "likely")
    done = decide(likely, priors(spark, likely, model.languages), model.languages) if model.languages else decide(likely, likely, [])
    language, best, kept = _verdict(done, model.languages)
    return done.select(F.col("__id").alias(id_col), language.alias("language"), best.alias("confidence"), F.col("__words").alias("n_words"), kept.alias("kept"))


def keep_identified(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", host_col: str | None = "source") -> DataFrame:
    """docs without the rows of which no language is likely enough: one pass for the priors, one that carries the rows along, each packed as one column."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _host(host_col).alias("__host"), F.lit(None).cast("string").alias("__declared"), F.col(text_col).alias("__text"))
    scratch = Scratch(spark, "language")
    slim = with_likelihoods(spark, own.select("__host", "__text"), model, "__text", True)
    prior = scratch.write(priors(spark, slim, model.languages), "priors") if model.languages else slim
    done = decide(with_likelihoods(spark, own, model, "__text", True), prior, model.languages)
    return done.where(_verdict(done, model.languages)[2]).select("row.*")
