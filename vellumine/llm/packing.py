"""Packing of documents into sequences of a fixed number of tokens: best fit, then swap-based local search.

A document is its token ids and an end token; longer ones are cut into whole sequences and a rest. Rests are dealt by a hash of their row to groups of GROUP on average, which are packed side by side: each takes the longest first into the fullest
sequence that has room. Local search then takes the sequences that are not full, the fullest first, and moves a rest from another one into it, exchanges one rest for a longer one, or two rests for a longer one and the other way round, where
that fills it most; each such step makes the sum of squared fills larger, so gaps gather in ever fewer sequences until these are empty. Sequences that stay loose in their groups are dealt to fewer groups again, until one group is left.

Cases: a null or empty text is its end token alone. Repeated rows, rows of one id and rows without an id are packed each. An empty table gives no rows. Very long texts are cut like others, however many pieces they
have. What happens within a group depends on its rows alone, not on their order. Other columns of documents, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.word_ids import encoder
from vellumine.plans.scratch import Scratch, ship

SIZE, END = 4096, 1
#: Rests of a group, on average.
GROUP = 20_000
#: A sequence with more than this share of gap is dealt again with those of other groups.
LOOSE = 1 / 64
#: Exchanges of two for one look at this many rests of a sequence, the longest.
PAIRED = 24
#: Sweeps of the local search over a group at most.
SWEEPS = 40


def pieces(spark: SparkSession, docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece (from 0), start (ids of the document before it), length and ids (binary, little-endian unsigned 32-bit) of each piece of at most size ids."""
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        own = encoder(shared.value)
        for b in batches:
            row, piece, start, length, held = [], [], [], [], []
            for i, ids in enumerate(own.encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(ids, end).astype("<u4")
                for j, lo in enumerate(range(0, len(ids), size)):
                    part = ids[lo : lo + size]
                    for column, x in ((row, i), (piece, j), (start, lo), (length, len(part)), (held, part.tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(held, pa.binary())], ["id", "piece", "start", "length", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


class Bins:
    """Sequences being filled; lengths of rests by their number."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.held: list[set[int]] = []
        self.fill: list[int] = []
        self.total = sum(lengths)

    def best_fit(self) -> None:
        room: list[list[int]] = [[] for _ in range(self.size + 1)]
        open_at = 0  # bit r: a sequence has r ids of room
        for i in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            n = self.lengths[i]
            wide = open_at >> n
            if wide:
                r = n + (wide & -wide).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    open_at ^= 1 << r
            else:
                b, r = len(self.held), self.size
                self.held.append(set())
                self.fill.append(0)
            self.held[b].add(i)
            self.fill[b] += n
            r -= n
            if r:
                room[r].append(b)
                open_at |= 1 << r

    def improve(self) -> None:
        """Sweeps over all that is not full, until one finds no step, no sequence could be saved, or SWEEPS are done."""
        for _ in range(SWEEPS):
            if not self._sweep():
                break

    def _least(self) -> int:
        return -(-self.total // self.size)

    def _sweep(self) -> bool:
        """Each sequence that is not full takes from those less full than itself, the fullest first."""
        loose = [b for b, n in enumerate(self.fill) if 0 < n < self.size]
        used = sum(n > 0 for n in self.fill)
        if used <= self._least():
            return False
        self.at: dict[int, set[int]] = {}  # length -> rests of that length in loose sequences
        self.home = {i: b for b in loose for i in self.held[b]}
        for i in self.home:
            self.at.setdefault(self.lengths[i], set()).add(i)
        self.bits = reduce(lambda m, n: m | 1 << n, self.at, 0)
        order = [(-self.fill[b], b) for b in loose]
        heapq.heapify(order)
        gained = False
        while order and used > self._least():
            n, b = heapq.heappop(order)
            if -n != self.fill[b] or not self.fill[b]:
                if 0 < self.fill[b] < self.size and -n > self.fill[b]:
                    heapq.heappush(order, (-self.fill[b], b))
                continue
            for i in self.held[b]:
                self._hide(i)
            while self.fill[b] < self.size and (step := self._step(b)):
                gained = True
                used -= self._exchange(b, *step)
        return gained

    def _hide(self, i: int) -> None:
        self.home.pop(i, None)
        same = self.at[n := self.lengths[i]]
        same.discard(i)
        if not same:
            self.bits &= ~(1 << n)

    def _show(self, i: int, b: int) -> None:
        self.home[i] = b
        self.at.setdefault(n := self.lengths[i], set()).add(i)
        self.bits |= 1 << n

    def _largest(self, least: int, most: int) -> int:
        """The greatest length from least to most that a loose sequence holds, or 0."""
        n = (self.bits & ((2 << most) - 1)).bit_length() - 1
        return n if n >= least and n > 0 else 0

    def _step(self, b: int):
        """What to take out and to put in to fill the sequence most."""
        gap, best = self.size - self.fill[b], (0, None)
        own = {self.lengths[i]: i for i in sorted(self.held[b], reverse=True)}
        some = sorted(own, reverse=True)[:PAIRED]
        outs = [(0, ()), *((n, (i,)) for n, i in own.items())]
        held = sorted(self.held[b], key=lambda i: (-self.lengths[i], i))[:PAIRED]
        pairs = {self.lengths[i] + self.lengths[j]: (i, j) for x, i in enumerate(held) for j in held[x + 1 :]}
        for n, out in [*outs, *pairs.items()]:
            got = self._largest(n + 1, min(n + gap, self.size))
            if got - n > best[0]:
                best = got - n, (out, (min(self.at[got]),))
                if best[0] == gap:
                    return best[1]
        # one of its own for two of the least full sequence that is not itself
        other = min((self.fill[o], o) for o in {self.home[i] for i in self._few()} or {b})[1]
        if other != b:
            theirs = sorted(self.held[other], key=lambda i: (-self.lengths[i], i))[:PAIRED]
            for x, i in enumerate(theirs):
                for j in theirs[x + 1 :]:
                    two = self.lengths[i] + self.lengths[j]
                    for n in (0, *some):
                        if best[0] < two - n <= gap and self.fill[b] + two - n > self.fill[other]:
                            best = two - n, ((own[n],) if n else (), (i, j))
        return best[1]

    def _few(self):
        """A rest of each of some lengths, the shortest and the longest."""
        if not self.bits:
            return []
        ends = {(self.bits & -self.bits).bit_length() - 1, self.bits.bit_length() - 1}
        return [min(self.at[n]) for n in ends]

    def _exchange(self, b: int, out: tuple, got: tuple) -> int:
        """Number of sequences that are emptied."""
        other = self.home[got[0]]
        for i in got:
            self._hide(i)
            self.held[other].discard(i)
            self.held[b].add(i)
        for i in out:
            self.held[b].discard(i)
            self.held[other].add(i)
            self._show(i, other)
        moved = sum(self.lengths[i] for i in got) - sum(self.lengths[i] for i in out)
        self.fill[b] += moved
        self.fill[other] -= moved
        return self.fill[other] == 0


def pack_lengths(lengths: list[int], size: int = SIZE) -> Bins:
    bins = Bins(lengths, size)
    bins.best_fit()
    bins.improve()
    return bins


def _packed(size: int, level: int):
    """Rows of a group with their sequence, their place there and its fill."""

    def run(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("row", "ascending")]
        table = table.sort_by(order)
        group = table.column("group")[0].as_py()
        bins = pack_lengths(table.column("length").to_pylist(), size)
        seq, place, fill = (np.zeros(table.num_rows, np.int64) for _ in range(3))
        lengths = bins.lengths
        for n, (b, held) in enumerate((b, h) for b, h in enumerate(bins.held) if h):
            at = 0
            for i in sorted(held):
                seq[i], place[i], fill[i] = (level << 56) + (group << 24) + n, at, bins.fill[b]
                at += lengths[i]
        for name, x in (("sequence_id", seq), ("offset", place), ("fill", fill)):
            table = table.append_column(name, pa.array(x))
        return table.drop_columns(["group"])

    return run


def pack(spark: SparkSession, parts: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """parts (any columns beside length, 1 to size) with sequence_id and offset: parts of one sequence stand side by side from 0. Keep other columns slim: they go along."""
    scratch = Scratch(spark, "packing")
    rows = scratch.write(parts.select(F.struct(*parts.columns).alias("part"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row")), "rows")
    whole = rows.where(F.col("length") >= size).select("part", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest, level = [whole], rows.where(F.col("length") < size), 0
    left = rest.count()
    schema = f"{rest._jdf.schema().toDDL()}, sequence_id long, offset long, fill long"
    while left:
        groups = -(-left // group)
        dealt = rest.select("part", "length", "row", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).alias("group"))
        packed = scratch.write(dealt.groupBy("group").applyInArrow(_packed(size, level), schema), f"level{level}")
        loose = packed.where(F.col("fill") < (1 - LOOSE) * size)
        again = loose.count() if groups > 1 else 0
        if not again or 2 * again > left:
            done.append(packed.select("part", "sequence_id", "offset"))
            break
        done.append(packed.where(F.col("fill") >= (1 - LOOSE) * size).select("part", "sequence_id", "offset"))
        rest, left, level = loose.select("part", "length", "row"), again, level + 1
    return reduce(DataFrame.unionAll, done).select("part.*", "sequence_id", "offset")


def sequences(spark: SparkSession, parts: DataFrame, size: int = SIZE) -> DataFrame:
    """sequence_id, n_tokens, ids (binary) and spans (offset, length, doc_id, piece) of the packed sequences of pieces()."""
    scratch = Scratch(spark, "sequences")
    own = scratch.write(parts.withColumn("__part", F.monotonically_increasing_id()), "pieces")
    places = pack(spark, own.select("__part", "length"), size)
    span = F.struct("offset", "length", "doc_id", "piece", "ids")
    each = own.join(places.drop("length"), "__part").groupBy("sequence_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    ids = F.aggregate("spans", F.lit(b""), lambda got, s: F.concat(got, s["ids"]))
    return each.select("sequence_id", (F.length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"), F.transform("spans", lambda s: s.dropFields("ids")).alias("spans"))
