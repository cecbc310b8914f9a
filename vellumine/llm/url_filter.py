"""URL filter: rules on host and path first, then logistic regression on hashed character runs of both.

The regression is trained from a small labelled table (LABELLED, a parameter): addresses made by rule from unwanted and everyday names and paths, in equal
settings, so that sub-domains, suffixes, languages and numbers tell nothing, and names that unwanted words only resemble. A url with a score of AT at least is blocked.

Host: after the first :// up to /, ? or #, A-Z in lower case; path: then up to ? or #. A rule is a verdict, a host and the start of a path; it
fits its host and all subdomains; the longest rule that fits wins, of equally long ones the first.

Cases: null, empty or without ://: host and path empty, no rule, no score but 0, so allowed. Very long urls are read whole. Repeated rows are judged each. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.textnum import U, mix
from vellumine.plans.scratch import ship

SLOTS, LENGTHS, RIDGE, AT = 1 << 18, (3, 4, 5), 0.05, 0.5
#: Verdict, host, start of path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words of unwanted addresses by topic; any two of a topic make a name.
UNWANTED = (
    "casino poker roulette jackpot slots betting bets blackjack bingo gambling",
    "porn xxx sex nude adult cams escort hentai milf erotic",
    "viagra cialis pills pharmacy xanax steroids tramadol rx meds",
    "payday loans quick cash credit instant money lender",
    "warez crack keygen torrent nulled serial pirate cracked",
    "phishing verify-account login-secure bank-login wallet-unlock account-suspended free-gift prize winner",
    "clickbait adserver popunder tracker adclick banner-ads doorway spamlinks linkfarm seo-backlinks",
    "replica watches fake handbags rolex outlet counterfeit",
)
#: Words of everyday hosts, and of their paths; some hold an unwanted word or most of one.
WANTED = """
library museum university school college hospital clinic kitchen recipes garden weather climate history archive journal magazine
news daily times herald gazette travel adventure hotel airport railway station bridge harbor island mountain river forest ocean
science physics chemistry biology algebra geometry statistics astronomy engineering software developers python kernel compiler database
music orchestra concert theater cinema film painting sculpture poetry novel books reading writing dictionary translation grammar
football cricket tennis cycling running swimming chess photography camera bicycle motorcycle carpentry knitting pottery sewing
government parliament council election justice police fire rescue charity foundation community church mosque temple society institute
farm dairy bakery coffee restaurant wine cheese chocolate vegetables market grocery fashion furniture lighting plumbing roofing
health nutrition dental optics veterinary pharmacology sussex essex middlesex sextant better betterhomes alphabet debts bankofengland savings
login accounts creditunion watchmaker bags pirates-cove spamhaus adserving-standards loanwords cash-museum analysis cumberland scunthorpe
wikipedia encyclopedia blog forum wiki docs support help about contact research education employment careers housing energy water
""".split()
PATHS = """
about index article story post page item view archive category topic guide manual reference tutorial lesson chapter section report paper review
interview opinion editorial calendar events schedule results gallery photo album map directions weather forecast recipe menu product catalog
download release changelog issue commit documentation faq question answer thread comment profile team staff member history biography
""".split()
SETTINGS = tuple((sub, top, lang) for sub in ("", "www.", "m.", "blog.") for top in ("com", "net", "org", "de", "info") for lang in ("en", "de", "es", "fr", ""))


def made_table() -> tuple[tuple[str, int], ...]:
    """Addresses and 1 for unwanted: names in hosts, unwanted words in paths of everyday hosts, everyday names and paths; each in some of SETTINGS in turn."""
    pairs = [(a, b) for topic in UNWANTED for a in topic.split() for b in topic.split() if a != b]
    rows, nth = [], 0

    def add(host: str, path: str, label: int) -> None:
        nonlocal nth
        sub, top, lang = SETTINGS[(37 * nth) % len(SETTINGS)]
        rows.append((f"https://{sub}{host}.{top}/{lang + '/' if lang else ''}{path}", label))
        nth += 1

    numbers = lambda i: str((7919 * i) % 9973) if i % 3 else ""
    for i, (a, b) in enumerate(pairs):
        joint = ("-", "", "24-", "-best-")[i % 4]
        if i % 3 < 2:
            add(f"{a}{joint}{b}", (numbers(i), PATHS[i % len(PATHS)], f"{a}/{numbers(i)}")[i % 3], 1)
        else:
            add(WANTED[(11 * i) % len(WANTED)], f"{a}/{b}{numbers(i)}", 1)
    for i, word in enumerate(WANTED):
        for j in range(5):
            other, path = WANTED[(i + 17 * j + 5) % len(WANTED)], PATHS[(3 * i + 7 * j) % len(PATHS)]
            add(*((f"{word}", numbers(i + j)), (f"{word}-{other}", path), (f"{word}{other}", f"{path}/{numbers(i + 2 * j)}"), (other, f"{path}/{word}"), (word, f"{path}-{PATHS[(i + j) % len(PATHS)]}"))[j], 0)
        add(f"{word}{WANTED[(i + 41) % len(WANTED)]}", numbers(i), 0)
    for i in range(300):  # names without a meaning are everyday ones
        name = "".join("bdfgklmnprstvz"[(i * k + k) % 14] + "aeiou"[(i // k + k) % 5] for k in (3, 5, 11, 13)[: 2 + i % 3])
        add(name + ("", "", "hub", "lab", "s", "net")[i % 6], (numbers(i), f"{PATHS[i % len(PATHS)]}/{numbers(i)}", f"{name}/{numbers(i)}")[i % 3], 0)
    return tuple(rows)


LABELLED = made_table()


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins as text, and its verdict; null without one."""
    text = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def runs_of(host: str, path: str) -> np.ndarray:
    """Slots of the distinct character runs, host and path apart."""
    out = []
    for part, text in enumerate((host, path)):
        data = np.frombuffer(f"^{text}$".encode(), np.uint8).astype(U)
        for n in LENGTHS:
            if len(data) >= n:
                h = np.zeros(len(data) - n + 1, U)
                for i in range(n):
                    h = h * U(257) + data[i : len(data) - n + 1 + i]
                out.append(mix(h + U((2 * n + part) << 48)) % U(SLOTS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def _parts(url: str) -> tuple[str, str]:
    import re

    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", "")


@lru_cache(4)
def train(labelled=LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias. Each row's runs count 1 / sqrt(their number); Newton steps in the space of the rows."""
    rows = [runs_of(*_parts(u)) for u, _ in labelled]
    y = np.array([v for _, v in labelled], float)
    slots, column = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_inverse=True)
    x = np.zeros((len(rows), len(slots)))
    x[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), column] = 1
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    gram, a, bias = x @ x.T, np.zeros(len(rows)), 0.0
    for _ in range(60):  # Newton steps for a and the bias together
        p = 1 / (1 + np.exp(-(gram @ a + bias)))
        s, left = p * (1 - p), y - p - RIDGE * a
        solved = np.linalg.solve(s[:, None] * gram + RIDGE * np.eye(len(a)), np.stack([left, s], axis=1))
        step_bias = ((y - p).sum() - s @ (gram @ solved[:, 0])) / max(1e-9, s.sum() - s @ (gram @ solved[:, 1]))
        step = solved[:, 0] - step_bias * solved[:, 1]
        a, bias = a + step, bias + step_bias
        if np.abs(step).max(initial=0) < 1e-9 and abs(step_bias) < 1e-9:
            break
    weights = np.zeros(SLOTS)
    weights[slots] = x.T @ a
    return weights, float(bias)


def judge(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED) -> DataFrame:
    """id, host, path, rule, verdict and score of every row."""
    ship(spark)
    shared = spark.sparkContext.broadcast(train(labelled))

    def run(batches):
        weights, bias = shared.value
        for b in batches:
            scores = []
            for host, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                r = runs_of(host, path)
                scores.append(1 / (1 + np.exp(-(weights[r].sum() / np.sqrt(max(1, len(r))) + bias))) if host or path else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], ["id", "host", "path", "score"])

    host, path = host_and_path(F.col(url_col))
    scored = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path")).mapInArrow(run, "id long, host string, path string, score double")
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("score") >= AT, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
