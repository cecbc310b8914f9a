"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

A text is scored by its worst unit: a word, or a run of single letters set apart ("i d i o t"). Letters are code points: case and common look-alikes are
folded, letters beyond a to z are told apart by their number. Units are compared by the subsequences of four letters that they share within a span of six, each weighted by DECAY to its span, so gaps and inserted
characters cost little; the kernel is scaled by each unit's own norm. Landmarks are units of the labelled sample;
the machine is trained on labelled sentences as bags of units (a bag is as toxic as its worst unit): each toxic text lends its worst unit, chosen anew in each
of ROUNDS, and clean texts lend random units and their worst. Margins become scores by a logistic curve
fitted out of fold: on the margins that each of FOLDS parts of the sample gets from a machine of the other parts. Each is also trained on with a letter inserted, toxic ones INSERTED times. In the space that the
landmarks span the machine is linear, so its weights fold into one table over all subsequences, and a text costs a few look-ups a letter.

Long words are taken in overlapping pieces, so whole texts are scored. Training takes at most SAMPLE texts of each label of at most
SAMPLE_CHARS characters, those with the least hashes; all else covers all rows.

Cases: a very long text or word is read whole, in pieces. Null or empty text, or no labels to learn from (none of one kind): the lowest score. Repeated rows are scored
each; a null id is not held out; null labels are not learned from. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.textnum import LOWER, U, hashes, mix, texts, words
from vellumine.plans.scratch import sample_bound, ship

SAMPLE, SAMPLE_CHARS, ROUNDS, DECAY = 1000, 20_000, 4, 0.7
#: Table entries; subsequences share one where their hashes do. One more, the first, is for none.
WIDTH, SLOTS = 24, 1 << 20
LANDMARKS, COST, LOWEST, AT = 192, 10.0, -4.0, 0.3
#: Copies of each toxic unit with a letter inserted somewhere, so that few units still show most places.
INSERTED = 4
#: Parts of the labelled sample, each scored by a machine of the others to fit the score's curve.
FOLDS = 3
START, END, SIGN, OTHER = 27, 28, 29, 30
#: Signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _kinds() -> np.ndarray:
    """The code of each code point up to U+FFFF: 1 to 26 for a to z and their look-alikes, SIGN for what is no letter, from OTHER on the rest by number, without case."""
    out = np.empty(1 << 16, np.uint8)
    for c in range(1 << 16):
        base = LOOKALIKES.get(chr(c)) or chr(c).lower()[:1]
        out[c] = ord(base) - 96 if "a" <= base <= "z" else OTHER + ord(base) % (64 - OTHER) if c >= 0x80 and unicodedata.category(base)[0] in "LMN" else SIGN
    return out


KIND = _kinds()


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the code points of UTF-8 bytes, and for each byte (and the end) how many code points begin before it."""
    begins = (data & 0xC0) != 0x80
    place = np.concatenate([[0], np.cumsum(begins)])
    at = np.flatnonzero(begins)
    lead = data[at].astype(np.int64)
    point = lead.copy()
    for first, size, mask in ((0xC0, 2, 31), (0xE0, 3, 15), (0xF0, 4, 7)):
        of = np.flatnonzero((lead >= first) & (lead < first + (0x10 if size == 3 else 0x20 if size == 2 else 0x08)))
        value = lead[of] & mask
        for i in range(1, size):
            value = value << 6 | (data[np.minimum(at[of] + i, len(data) - 1)] & 63)
        point[of] = value
    return KIND[point & 0xFFFF], place


#: Places of the second to fourth letter after the first, and the weight of each such subsequence.
GAPS = [(i, j, k, DECAY ** (k - 3)) for k in range(3, 6) for j in range(2, k) for i in range(1, j)]
#: Lengths of the runs of letters whose odds choose the first units.
RUNS = range(4, 9)
#: A toxic text lends a unit only if a run of its letters is in so many toxic texts, with these log odds at least.
SUPPORT, ODDS = 3, 3.0


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of letters for each unit or piece of one, and the unit that each row is of."""
    most = WIDTH - 2
    size = ends - starts
    pieces = np.maximum(1, -(-(size - most) // (most // 2)) + 1)
    of = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = starts[of] + nth * (most // 2)
    n = np.minimum(most, ends[of] - at)
    cols = np.arange(most)
    out = np.zeros((len(of), WIDTH), np.uint8)
    out[:, 0] = START
    if len(of):
        out[:, 1:-1] = np.where(cols < n[:, None], data[np.minimum(at[:, None] + cols, len(data) - 1)], 0)
    out[np.arange(len(of)), n + 1] = END
    return out, of


def apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letters of the runs of three or more one-letter words, in pieces, and the text of each."""
    one = (ends - starts) == 1
    if not one.any():
        return np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    where = np.flatnonzero(one)
    new = np.concatenate([[True], (where[1:] != where[:-1] + 1) | (doc[where[1:]] != doc[where[:-1]])])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(where))
    rows, of = [], []
    for a, b in zip(lo[hi - lo >= 3], hi[hi - lo >= 3], strict=True):
        single = data[starts[where[a:b]]]
        for i in range(0, max(1, len(single) - (WIDTH - 2) // 2), (WIDTH - 2) // 2):
            piece = single[i : i + WIDTH - 2]
            row = np.zeros(WIDTH, np.uint8)
            row[0], row[1 : len(piece) + 1], row[len(piece) + 1] = START, piece, END
            rows.append(row)
            of.append(doc[where[a]])
    return (np.stack(rows), np.array(of)) if rows else (np.zeros((0, WIDTH), np.uint8), np.zeros(0, np.int64))


def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the table index of each subsequence (0: none) and its weight over the row's norm."""
    wide = rows.astype(np.uint32)
    pairs = {g: wide[:, : WIDTH - g] * np.uint32(64) + wide[:, g:] for g in range(1, 5)}
    index, weight = [], []
    for i, j, k, w in GAPS:
        n = WIDTH - k
        x = pairs[i][:, :n] * np.uint32(4096) + pairs[k - j][:, j : j + n]
        whole = (wide[:, :n] > 0) & (wide[:, k:] > 0)
        index.append(np.where(whole, ((x * np.uint32(2654435761)) >> np.uint32(12)) + np.uint32(1), 0))
        weight.append(np.full(n, w, np.float32))
    index, weight = np.concatenate(index, axis=1), np.concatenate(weight)
    there = np.where(index > 0, weight, np.float32(0))
    norm = np.sqrt((there * there).sum(axis=1))
    return index, there / np.maximum(norm, 1e-9)[:, None]


def values(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.float32)
    for i in range(0, len(rows), 4096):
        index, weight = features(rows[i : i + 4096])
        out[i : i + 4096] = (table[index] * weight).sum(axis=1)
    return out


@dataclass
class Model:
    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, column: pa.Array) -> np.ndarray:
        """The worst unit's margin of each text."""
        out = []
        for lo, hi, data, off in texts(column):
            low = LOWER[data]
            starts, ends, first = words(low, off)
            code, place = letters(data)
            worst = np.full(hi - lo, LOWEST, np.float32)
            if len(starts):
                _, at, back = np.unique(hashes(low, starts, ends), return_index=True, return_inverse=True)
                rows, of = codes(code, place[starts[at]], place[ends[at]])
                best = np.full(len(at), LOWEST, np.float32)
                np.maximum.at(best, of, values(self.table, rows) + np.float32(self.bias))
                full = np.flatnonzero(np.diff(first))
                worst[full] = np.maximum.reduceat(best[back], first[full])
                rows, of = apart(code, place[starts], place[ends], first)
                if len(of):
                    np.maximum.at(worst, of, values(self.table, rows) + np.float32(self.bias))
            out.append(np.maximum(worst, LOWEST))
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margins(column).astype(np.float64) + self.offset)))


def nobody() -> Model:
    return Model(np.zeros(SLOTS + 1, np.float32), LOWEST, 1.0, 0.0)


def _inserted(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each row with one letter or sign put between two of its letters."""
    out = rows.copy()
    for row in out:
        n = int((row > 0).sum())
        if 5 <= n < WIDTH:
            at = int(rng.integers(2, n - 1))
            row[at + 1 :] = row[at:-1].copy()
            row[at] = int(rng.integers(1, 27)) if rng.random() < 0.5 else 29
    return out


def _machine(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps."""
    w = np.zeros(z.shape[1])
    for _ in range(30):
        on = y * (z @ w) < 1
        a = z[on] * cost[on, None]
        new = np.linalg.solve(np.eye(len(w)) * 0.5 + a.T @ z[on], a.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def train(sample: list[tuple[str, int]], seed: int = 7) -> Model:
    """A model of (text, label) rows. Its curve is fitted out of fold; on the sample's own margins where a part leaves the others nothing to learn from."""
    model = _learn(sample, seed)
    if not model.table.any():
        return model
    y = np.array([int(label) for _, label in sample])
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        fold[of] = np.arange(len(of)) % FOLDS
    margin = np.empty(len(y))
    for f in range(FOLDS):
        other = _learn([row for row, at in zip(sample, fold, strict=True) if at != f], seed)
        if not other.table.any():
            other = model
        margin[fold == f] = other.margins(pa.array([row[0] for row, at in zip(sample, fold, strict=True) if at == f], pa.string()))
    return Model(model.table, model.bias, *_logistic(margin, y))


def _learn(sample: list[tuple[str, int]], seed: int) -> Model:
    """The machine of (text, label) rows, without a curve."""
    rng = np.random.default_rng(seed)
    y = np.array([int(label) for _, label in sample])
    if len(y) == 0 or y.min() == y.max():
        return nobody()
    # few objects: the driver trains, beside its JVM
    mine = []
    for text, _ in sample:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        own = np.zeros((0, WIDTH), np.uint8)
        if len(raw):
            starts, ends, first = words(raw, np.array([0, len(raw)]))
            code, place = letters(raw)
            starts, ends = place[starts], place[ends]
            own = np.concatenate([codes(code, starts, ends)[0], apart(code, starts, ends, first)[0]])
        mine.append(np.unique(own.view(f"S{WIDTH}").ravel()))
    doc = np.repeat(np.arange(len(mine)), [len(m) for m in mine])
    known, unit = np.unique(np.concatenate(mine), return_inverse=True)
    del mine
    if not len(known):
        return nobody()
    rows, unit = np.frombuffer(known.tobytes(), np.uint8).reshape(-1, WIDTH), unit.astype(np.int32)
    # how much more often toxic texts hold a run of letters starts the choice of units
    value, lent = np.full(len(rows), -9.0), np.zeros(len(rows), bool)
    edges = np.searchsorted(doc, np.arange(len(sample) + 1))
    for n in RUNS:
        runs = np.empty((len(rows), WIDTH - n + 1), np.int32)
        for i in range(WIDTH - n + 1):
            h = np.zeros(len(rows), U)
            for j in range(i, i + n):
                h = h * U(64) + rows[:, j]
            runs[:, i] = mix(h) % U(SLOTS)
        runs[rows[:, n - 1 :] == 0] = 0
        counts = np.zeros((2, SLOTS), np.int32)
        for d in range(len(sample)):
            counts[y[d], np.unique(runs[unit[edges[d] : edges[d + 1]]])] += 1
        odds = (np.log((counts[1] + 0.5) / (y.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - y).sum() + 1))).astype(np.float32)
        odds[0] = -9
        value = np.maximum(value, odds[runs].max(axis=1))
        lent |= ((counts[1][runs] >= SUPPORT) & (odds[runs] >= ODDS)).any(axis=1)
    clean_units = np.unique(unit[y[doc] == 0])
    model = nobody()
    for turn in range(ROUNDS):
        worst = {}
        for d in range(len(sample)):
            own = unit[edges[d] : edges[d + 1]]
            own = own[lent[own]] if y[d] else own
            if len(own):
                worst[d] = own[np.argmax(value[own])]
        bad, times = np.unique([u for d, u in worst.items() if y[d]], return_counts=True)
        hard = np.unique([u for d, u in worst.items() if not y[d]])
        if not len(bad) or not len(clean_units):
            return nobody()
        bad, times = bad[np.argsort(-times, kind="stable")], np.sort(times)[::-1]
        easy = rng.choice(clean_units, min(4000, len(clean_units)), replace=False)
        marks = _landmarks(rows, bad[:400], LANDMARKS // 2)
        marks = np.concatenate([marks, rng.choice(hard, min(len(hard), LANDMARKS // 4), replace=False), easy[: LANDMARKS // 4]])
        land = _dense(rows[marks])
        x = np.concatenate([rows[bad], *(_inserted(rows[bad], rng) for _ in range(INSERTED)), rows[hard], _inserted(rows[hard], rng), rows[easy]])
        label = np.repeat([1, 1, -1, -1, -1], [len(bad), INSERTED * len(bad), len(hard), len(hard), len(easy)])
        cost = np.where(label > 0, COST * len(label) / max(1, (label > 0).sum()) / 4, COST)
        cost[: len(bad)] *= np.minimum(times, 20) / times.mean()
        gram = land.between(rows[marks])
        power, vectors = np.linalg.eigh(gram + 1e-6 * np.eye(len(gram)))
        to = vectors[:, power > 1e-5] / np.sqrt(power[power > 1e-5])
        z = np.concatenate([land.between(x) @ to, np.ones((len(x), 1))], axis=1)
        w = _machine(z, label.astype(float), cost)
        table = land.table(to @ w[:-1])
        value = values(table, rows) + w[-1]
        model = Model(table, float(w[-1]), 1.0, 0.0)
    return model


class _dense:
    """Landmarks over the subsequences that they have."""

    def __init__(self, rows: np.ndarray):
        index, weight = features(rows)
        self.seen = np.unique(index[index > 0])
        self.column = np.full(SLOTS + 1, len(self.seen), np.int32)
        self.column[self.seen] = np.arange(len(self.seen))
        self.of = self.spread(index, weight)

    def spread(self, index, weight):
        out = np.zeros((len(index), len(self.seen) + 1), np.float32)
        np.add.at(out, (np.arange(len(index))[:, None], self.column[index]), weight)
        return out[:, :-1]

    def between(self, rows):
        return np.concatenate([self.spread(*features(rows[i : i + 512])) @ self.of.T for i in range(0, len(rows), 512)])

    def table(self, alpha):
        out = np.zeros(SLOTS + 1, np.float32)
        out[self.seen] = alpha @ self.of
        return out


def _landmarks(rows: np.ndarray, units: np.ndarray, most: int) -> np.ndarray:
    """Units that are unlike each other, the commonest first."""
    land = _dense(rows[units])
    near, chosen = np.full(len(units), -1.0), [0]
    while len(chosen) < min(most, len(units)):
        near = np.maximum(near, land.of @ land.of[chosen[-1]])
        near[chosen] = 9
        chosen.append(int(np.argmin(near)))
    return units[chosen]


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 given the margin."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([m, np.ones(len(m))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def is_held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out."""
    own = docs.select(F.col("doc_id").alias("id"), F.col("text")).where(~is_held_out("doc_id") & (F.length("text") <= SAMPLE_CHARS))
    of = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    of = of.where(~F.coalesce(F.crc32(F.col("id").cast("string")) % 4 == 2, F.lit(False)))
    turn = F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 1)
    counts = {r["label"]: r["count"] for r in of.groupBy("label").count().collect()}  # two rows at most
    rows = []
    for label, count in sorted(counts.items()):
        least = of.where((F.col("label") == label) & (turn <= sample_bound(count, SAMPLE))).orderBy(turn, "id").limit(SAMPLE)
        rows += own.join(F.broadcast(least), "id").orderBy(turn, "id").select("text", "label").collect()
    return train([(r["text"], r["label"]) for r in rows])


def score(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = shared.value.scores(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(s), pa.array((s >= AT).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows predicted toxic."""
    ship(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(at)) < AT))

    return docs.mapInArrow(run, docs.schema)
