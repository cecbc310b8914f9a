"""Near-duplicate documents by a chosen-path set similarity join.

Each document's set of word shingles is embedded in SIZE minwise tokens. A tree starts with all documents at its
root; each node picks one or two tokens by a hash of its path (1 / threshold on average) and sends every document to
the child that its value of the token names, so alike documents stay together and others part. Nodes with at most
SMALL documents are compared exhaustively. In larger ones, which are groups of copies or await more levels, each document
is compared with one centre per node; as trees have other centres, a group links up without all of its pairs.
What is then still apart within a large node branches on, and in the end each such rest is compared with all members
of the component that its node mainly holds, in blocks of BLOCK by BLOCK texts, so that no pair becomes a row.
Pairs pass a 64-bit sketch first; every link is confirmed on the full shingle sets. Trees are repeated until a pair
at the threshold is missed by all, or by the sketch, with probability RISK at most, also if all the nodes that it shares are large
and it must stay together for the further levels too. As all trees draw from the same tokens, that is averaged over how many of these a pair shares.

Documents with equal sets count once, so copies never make pairs. A set goes by its smallest id; where ids repeat over rows with unlike
sets, by a number of its own, and texts are then kept by that number.

Hot keys: a large node, a document in many pairs and a component with many members are dealt to several tasks; what they are joined with is small
and sent to each. Blocks are bounded by texts and by bytes.

Cases: no words or null text: n_shingles 0, linked with nothing. Fewer words than k: the whole sequence is the one shingle.
Repeated ids: each row gets a row, with the component of its own text; an id may so stand in several components. Null id: n_shingles, component_id of the copies'
group (null if none has an id), kept false. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.joins import BROADCAST_IDS, beside, dealt, unused
from vellumine.llm.textnum import LOWER, U, hashes, mix, shingles, texts, words
from vellumine.plans.scratch import Scratch

SIZE, SMALL, RISK = 96, 16, 1e-4
#: Levels of a tree at least; more where there are over 8 * 20 ** LEVELS sets, as unlike sets agree on a token in one case of 20 at most.
LEVELS = 4
#: The part of RISK that the sketch may take; the trees have the rest.
SKETCH_PART = 0.15
#: Nodes with more than one component, of three numbers each, are broadcast up to this many, else joined by a shuffle.
BROADCAST_NODES = 400_000
#: Trees whose nodes are shuffled together at first: what lies on disk at once. Each further round takes twice as many, as the driver's work is in rounds.
AT_ONCE = 4
#: Levels that one more branching adds, and how often.
DEEPER, AGAIN = 3, 1
#: Texts of a block and their bytes, on average, and distinct shingles of two blocks that are counted at once.
BLOCK, BLOCK_BYTES, COLUMNS = 64, 1 << 20, 20_000
#: Rows of a key that one task takes.
SPLIT = 500
_RNG = np.random.default_rng(20240601)
_XOR, _MULT = _RNG.integers(0, 1 << 63, SIZE, dtype=np.int64).astype(U), _RNG.integers(0, 1 << 63, SIZE, dtype=np.int64).astype(U) * U(2) + U(1)


def sets(data, off, k):
    """Each text's shingle hashes, and the index of each text's first."""
    data = LOWER[data]
    starts, ends, first = words(data, off)
    return shingles(hashes(data, starts, ends), first, k)


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def minwise(x: np.ndarray) -> np.ndarray:
    """SIZE minwise tokens of a set of hashes, 32 bits each."""
    low = np.full(SIZE, ~U(0), U)
    for i in range(0, len(x), 512):
        np.minimum(low, ((x[i : i + 512, None] ^ _XOR) * _MULT).min(axis=0), out=low)
    return (low >> U(32)).astype(np.uint32)


def fingerprint(x: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set of hashes."""
    two = np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64)
    return int(two[0]), int(two[1])


def each_set(column, k):
    """The sorted set of each text's shingles; None of a text without words."""
    for _, _, data, off in texts(column):
        made, at = sets(data, off, k)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            yield distinct(made[lo:hi]) if hi > lo else None


def sign(k: int):
    """id and text to id, size of the set, fingerprint, minwise tokens and sketch."""

    def run(batches):
        for b in batches:
            rows = {"n": [], "f1": [], "f2": [], "sig": [], "sketch": []}
            for x in each_set(b.column(1), k):
                made = (0, None, None, None, None)
                if x is not None:
                    sig = minwise(x)
                    bits = np.packbits((mix(sig[:64].astype(U)) & U(1)).astype(np.uint8)).view(np.int64)
                    made = (len(x), *fingerprint(x), sig.tobytes(), int(bits[0]))
                for c, v in zip(rows.values(), made, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))], ["id", *rows])

    return run


def with_fingerprints(docs: DataFrame, text_col: str, k: int, names: tuple[str, str]) -> DataFrame:
    """docs and, under these names, each row's fingerprint (null without words)."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            made = [(None, None) if x is None else fingerprint(x) for x in each_set(b.column(at), k)]
            f1, f2 = zip(*made, strict=True) if made else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], [*b.schema.names, *names])

    return docs.mapInArrow(run, type(docs.schema)(list(docs.schema.fields)).add(names[0], "long").add(names[1], "long"))


def _children(sig, doc, node, levels):
    """Follow each (document, node) down so many levels."""
    for _ in range(levels):
        pick = mix(node ^ U(0x5851F42D4C957F2D))
        one = (pick % U(SIZE)).astype(np.int64)
        twice = np.flatnonzero((pick >> U(40)) % U(4) == 0)  # 1.25 tokens on average: 1 / threshold
        two = (one[twice] + 1 + ((pick[twice] >> U(16)) % U(SIZE - 1)).astype(np.int64)) % SIZE
        doc, at, token = np.concatenate([doc, doc[twice]]), np.concatenate([node, node[twice]]), np.concatenate([one, two])
        node = mix(at * U(0x2545F4914F6CDD1D) ^ mix(sig[doc, token].astype(U) + (token.astype(U) << U(32))))
    return doc, node


def branch(levels: int, trees: range | None):
    """From the roots of `trees`, or from the nodes in the third column, down so many levels."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, SIZE)
            n = len(sig)
            if trees is None:
                at = b.column(3)
                doc = np.repeat(np.arange(n), np.asarray(at.value_lengths()))
                node = np.asarray(at.flatten()).astype(np.int64).view(U)
            else:
                doc, node = np.tile(np.arange(n), len(trees)), np.repeat(mix(np.array(trees, U) + U(77)), n)
            doc, node = _children(sig, doc, node, levels)
            order = np.unique(np.stack([node.view(np.int64), doc]), axis=1)
            ids, sketch = np.asarray(b.column(0)), np.asarray(b.column(2))
            for i in range(0, order.shape[1], 50_000):
                nodes, docs = order[:, i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(ids[docs]), pa.array(sketch[docs])], ["node", "rep", "sketch"])

    return run


def confirm(k: int, percent: int):
    """Pairs of texts: whether 100 * intersection >= percent * union of their full sets."""

    def run(batches):
        kept: OrderedDict = OrderedDict()

        def of(i, text):
            if i not in kept:
                data = np.frombuffer(text.encode(), np.uint8)
                kept[i] = distinct(sets(data, np.array([0, len(data)]), k)[0])
                if len(kept) > 200:
                    kept.popitem(last=False)
            return kept[i]

        for b in batches:
            linked = []
            for i, j, x, y in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                x, y = of(i, x), of(j, y)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def confirm_blocks(k: int, percent: int):
    """Two blocks of texts with their components: for each text of the first, one link to each component that the second links it with."""

    def run(batches):
        for b in batches:
            out = set()
            for xs, ys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = []
                for rows in (xs, ys):
                    data = [(r["text"] or "").encode() for r in rows]
                    all_, at = sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), k)
                    made.append([distinct(all_[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)])
                sizes = [np.array([len(x) for x in m], np.int64) for m in made]
                vocabulary, column = np.unique(np.concatenate([np.concatenate(m) for m in made]), return_inverse=True)
                split = int(sizes[0].sum())
                row = [np.repeat(np.arange(len(n)), n) for n in sizes]
                cols = [column[:split], column[split:]]
                common = np.zeros((len(xs), len(ys)))
                for lo in range(0, len(vocabulary), COLUMNS):
                    parts = []
                    for r, c, n in zip(row, cols, sizes, strict=True):
                        part, here = np.zeros((len(n), COLUMNS), np.float32), (c >= lo) & (c < lo + COLUMNS)
                        part[r[here], c[here] - lo] = 1
                        parts.append(part)
                    common += parts[0] @ parts[1].T
                linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1] - common)
                for i, j in np.argwhere(linked & (common > 0)):
                    if xs[i]["comp"] != ys[j]["comp"]:
                        out.add((min(xs[i]["comp"], ys[j]["comp"]), max(xs[i]["comp"], ys[j]["comp"])))
            x, y = zip(*sorted(out), strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    return run


def missed(levels: int, like: float) -> float:
    """Probability that a pair this alike shares no node of one tree at this level."""
    gone = 0.0
    for _ in range(levels):
        x = 1 - like + like * gone
        gone = 0.75 * x + 0.25 * x * x
    return gone


def binomial(n: int, p: float) -> list[float]:
    return [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]


def trees_miss(trees: int, levels: int, like: float) -> float:
    """Probability that a pair this alike shares no node at this level in any of the trees, which all draw from the same SIZE tokens."""
    return sum(p * missed(levels, shared / SIZE) ** trees for shared, p in enumerate(binomial(SIZE, like)))


def plan(depth: int, like: float) -> tuple[int, int]:
    """The trees, and the bits in which sketches may differ. Large nodes branch on, so pairs must be found AGAIN * DEEPER levels below depth."""
    apart = binomial(64, (1 - like) / 2)  # each token that differs changes its bit in one case of two
    bits = next(m for m in range(65) if sum(apart[m + 1 :]) <= SKETCH_PART * RISK)
    trees, left = 1, RISK - sum(apart[bits + 1 :])
    while trees_miss(trees, depth + AGAIN * DEEPER, like) > left:
        trees += 1
    return trees, bits


def rounds(trees: int) -> list[range]:
    """The trees of each round: AT_ONCE, then twice as many each time."""
    out, start, size = [], 0, AT_ONCE
    while start < trees:
        out.append(range(start, min(start + size, trees)))
        start, size = start + size, 2 * size
    return out


def components(scratch: Scratch, edges: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(v, l): the smallest vertex that each vertex of edges (x, y) reaches, and the number of vertices. Minimum label of neighbours, then a jump to the label's label, until nothing changes."""
    # both ways, and each vertex with itself, so that its own label comes with its neighbours'
    ways = F.array(*(F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in ("xy", "yx", "xx", "yy")))
    both, seen = scratch.counted(edges.select(F.inline(ways)).distinct(), f"{name}-edges")
    label = both.select(F.col("x").alias("v"), F.col("y").alias("l"))
    if not seen["rows"]:
        return label, 0
    label, seen = scratch.counted(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("l")), f"{name}-0")
    i, count = 0, seen["rows"]
    while True:
        i += 1
        low = beside(both, label.select(F.col("v").alias("y"), "l"), "y", count, "inner").groupBy(F.col("x").alias("v")).agg(F.min("l").alias("n"), F.max(F.when(F.col("x") == F.col("y"), F.col("l"))).alias("was"))
        heads = label.select(F.col("v").alias("n"), F.col("l").alias("next"))
        if count > BROADCAST_IDS:  # else the one broadcast of all labels serves both joins
            heads = heads.join(low.select("n").distinct(), "n", "left_semi")
        low = beside(low, heads, "n", count).select("v", F.least("n", F.coalesce("next", "n")).alias("l"), "was")
        low, seen = scratch.counted(low, f"{name}-{i}", moved=F.col("l") != F.col("was"))
        label = low.select("v", "l")
        if not seen["moved"]:
            return label, count


def few(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast, where it has so few rows of a number or two."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def classes(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """One row per row of docs: id, n (set size), f1 and f2 (fingerprint) and grp (the group), null without words, component (smallest id reachable)."""
    scratch = Scratch(spark, "neardup")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = scratch.write(own.mapInArrow(sign(k), "id long, n long, f1 long, f2 long, sig binary, sketch long"), "signed")
    reps, seen = scratch.counted(signed.where("f1 is not null and id is not null").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("sig").alias("sig"), F.max("sketch").alias("sketch")).withColumn("first", F.col("rep")), "reps")
    signed = scratch.write(signed.select("id", "n", "f1", "f2"), "fingerprints")  # tokens are kept once, in reps
    scratch.drop("signed")
    repeated = reps.groupBy("rep").count().where("count > 1").limit(1).count() > 0
    if repeated:
        reps = scratch.write(reps.withColumn("rep", F.monotonically_increasing_id()), "numbered")  # fixed once written
        marked = with_fingerprints(own.where("id is not null"), "text", k, ("f1", "f2")).where("f1 is not null")
        own = scratch.write(marked.join(reps.select("f1", "f2", "rep"), ["f1", "f2"]).dropDuplicates(["rep"]).select(F.col("rep").alias("id"), "text"), "texts")
    count, like = max(2, seen["rows"]), percent / 100
    depth = max(LEVELS, math.ceil(math.log(count / 8) / math.log(20)))
    trees, apart = plan(depth, like)
    state = {"moved": None, "many": 0, "tested": None, "large": None, "step": 0, "held": 0}
    shape = "node long, rep long, sketch long"

    def in_component(nodes: DataFrame) -> DataFrame:
        if state["moved"] is None:
            return nodes.withColumn("comp", F.col("rep"))
        return nodes.join(few(state["moved"], state["many"]), "rep", "left").select("node", "rep", *(c for c in nodes.columns if c not in ("node", "rep")), F.coalesce("comp", "rep").alias("comp"))

    def labelled(nodes: DataFrame) -> DataFrame:
        """With each document's component so far; only nodes that hold more than one. Both shuffles of the nodes carry three or five numbers a row."""
        turn = F.xxhash64("rep", "node")
        if state["moved"] is None:
            held = nodes.groupBy("node").agg(F.count("*").alias("held"), F.min(turn).alias("centre")).where("held > 1")
        else:
            held = in_component(nodes.select("node", "rep")).groupBy("node").agg(F.count("*").alias("held"), F.min(turn).alias("centre"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
        state["held"] += 1
        held, seen = scratch.counted(held.select("node", "held", "centre"), f"held-{state['held']}")
        return in_component(beside(nodes, held, "node", seen["rows"], "inner", BROADCAST_NODES)).withColumn("turn", turn)

    def meet(a: DataFrame, b: DataFrame, once: bool) -> DataFrame:
        """Pairs of one node and part whose components differ and whose sketches are near."""
        a, b = (x.select("node", "part", *(F.col(c).alias(f"{c}{s}") for c in ("rep", "sketch", "comp"))) for x, s in ((a, 1), (b, 2)))
        near = (F.col("comp1") != F.col("comp2")) & (F.col("rep1") < F.col("rep2") if once else F.lit(True)) & (F.bit_count(F.col("sketch1").bitwiseXOR(F.col("sketch2"))) <= apart)
        return a.join(b, (a["node"] == b["node"]) & (a["part"] == b["part"]) & near).select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b"))

    def all_pairs(nodes: DataFrame) -> DataFrame:
        nodes = nodes.withColumn("part", F.lit(0).cast("long"))
        return meet(nodes, nodes, True)

    def centre_pairs(nodes: DataFrame) -> DataFrame:
        """Each document with its node's centre. A node is dealt to a task for every SPLIT documents, and its centre to all of them."""
        parts = F.ceil(F.col("held") / SPLIT)
        return meet(nodes.where("turn = centre").withColumn("part", dealt(parts)), nodes.withColumn("part", F.pmod(F.xxhash64("rep"), parts)), False)

    def settle(pairs: DataFrame) -> None:
        """Confirm the pairs that are new and merge the components that they link. A text that is in more than SPLIT pairs is sent to several tasks."""
        step = state["step"] = state["step"] + 1
        pairs = pairs.distinct()
        if state["tested"] is not None:
            pairs = pairs.join(state["tested"], ["a", "b"], "left_anti")
        pairs, seen = scratch.counted(pairs, f"pairs-{step}")
        if not seen["rows"]:
            return
        state["tested"] = pairs if state["tested"] is None else state["tested"].union(pairs)
        ids, seen = scratch.counted(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.ceil(F.count("*") / SPLIT).alias("parts")), f"ids-{step}", hot=F.col("parts") > 1)
        hot, hots = ids.where("parts > 1"), seen["hot"]
        found = scratch.write(own.join(few(ids, seen["rows"]), "id").dropDuplicates(["id"]).withColumn("part", dealt(F.col("parts"))), f"texts-{step}")
        both = pairs
        for c, other in (("a", "b"), ("b", "a")):
            both = beside(both, hot.select(F.col("id").alias(c), F.col("parts").alias(f"of_{c}")), c, hots) if hots else both.withColumn(f"of_{c}", F.lit(1))
            both = both.withColumn(f"part_{c}", F.pmod(F.xxhash64(other), F.coalesce(f"of_{c}", F.lit(1))))
        for c, text in (("a", "x"), ("b", "y")):
            both = both.join(found.select(F.col("id").alias(c), F.col("part").alias(f"part_{c}"), F.col("text").alias(text)), [c, f"part_{c}"])
        links = scratch.write(both.select("a", "b", "x", "y").mapInArrow(confirm(k, percent), "a long, b long, linked boolean").where("linked").select("a", "b"), f"links-{step}")
        scratch.drop(f"texts-{step}")
        if state["moved"] is not None:
            for c in ("a", "b"):
                links = beside(links, state["moved"].select(F.col("rep").alias(c), "comp"), c, state["many"]).withColumn(c, F.coalesce("comp", c)).drop("comp")
        merge(links.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y"))

    def merge(edges: DataFrame) -> None:
        """Join up components that edges link."""
        step = state["step"]
        merged, vertices = components(scratch, edges, f"components-{step}")
        if not vertices:
            return
        fresh = merged.where("v <> l").select(F.col("v").alias("rep"), F.col("l").alias("comp"))
        if state["moved"] is not None:
            fresh = fresh.union(beside(state["moved"], merged.select(F.col("v").alias("comp"), "l"), "comp", vertices).select("rep", F.coalesce("l", "comp")))
        state["moved"], seen = scratch.counted(fresh, f"moved-{step}")
        state["many"] = seen["rows"]

    def in_blocks(rest: DataFrame) -> None:
        """Compare what is outside its node's main component with all of that component, and with what else is outside. Each pair of blocks is a task's row of its own."""
        state["step"] += 1
        sizes = rest.groupBy("node", "comp").agg(F.count("*").alias("of"))
        main = scratch.write(sizes.groupBy("node").agg(F.max_by("comp", F.struct("of", -F.col("comp"))).alias("main")), "mains")
        outside = scratch.write(beside(rest, main, "node", main.count(), "inner").where("comp <> main").select("rep", "comp", "main").distinct(), "outside")
        mains = outside.select("main").distinct()
        # the smallest id of a component is one of its members, but is not in `moved`
        inside = mains.select(F.col("main").alias("rep"), "main")
        if state["moved"] is not None:
            inside = inside.union(beside(state["moved"].select("rep", F.col("comp").alias("main")), mains, "main", mains.count(), "inner").select("rep", "main"))
        every = outside.withColumn("out", F.lit(True)).select("rep", "comp", "main", "out").union(inside.select("rep", F.col("main").alias("comp"), "main", F.lit(False)))
        ids = scratch.write(every.select(F.col("rep").alias("id")).distinct(), "block-ids")
        found = own.join(few(ids, ids.count()), "id", "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("rep"), "text")
        members = scratch.write(every.join(found, "rep"), "members")
        blocks = members.groupBy("main").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).alias("blocks"))
        item = F.struct(F.col("rep").alias("id"), "comp", "text")
        placed = beside(members, blocks, "main", blocks.count(), "inner").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
        held = scratch.write(placed.groupBy("main", "blocks", "block", "out").agg(F.collect_list(item).alias("rows")), "blocks")
        first = held.where("out").select("main", F.col("rows").alias("xs"), dealt(F.col("blocks")).alias("block"))
        second = held.select("main", "block", F.col("rows").alias("ys"))
        merge(scratch.write(first.join(second, ["main", "block"]).select("xs", "ys").mapInArrow(confirm_blocks(k, percent), "x long, y long").distinct(), "block-links"))

    def compare(nodes: DataFrame, name: str, centres_first: bool = False) -> DataFrame:
        """Small nodes exhaustively, the others against a centre; returns what the large nodes hold. Groups that centres link up first send fewer pairs of texts."""
        active = scratch.write(labelled(nodes), name)
        small, large = active.where(F.col("held") <= SMALL), active.where(F.col("held") > SMALL)
        if centres_first:
            settle(centre_pairs(active))
            settle(all_pairs(in_component(small.drop("comp"))))
        else:
            settle(all_pairs(small).union(centre_pairs(large)))
        return large.select("node", "rep", "sketch")

    for i, some in enumerate(rounds(trees)):
        left = compare(reps.select("rep", "sig", "sketch").mapInArrow(branch(depth, some), shape), f"nodes-{i}", centres_first=i == 0)
        state["large"] = left if state["large"] is None else state["large"].union(left)
    rest = state["large"]
    for i in range(AGAIN):
        rest, seen = scratch.counted(labelled(rest).select("node", "rep", "sketch"), f"rest-{i}")
        if not seen["rows"]:
            break
        of = rest.groupBy("rep").agg(F.collect_list("node").alias("at"))  # at most one node for each tree and choice
        own_tokens = reps.join(few(of.select("rep"), rest.select("rep").distinct().count()), "rep", "left_semi").select("rep", "sig", "sketch")
        deeper = scratch.write(own_tokens.join(of, "rep").select("rep", "sig", "sketch", "at"), f"tokens-{i}")  # read twice
        rest = compare(deeper.mapInArrow(branch(DEEPER, None), shape), f"deeper-{i}")
    else:
        rest, seen = scratch.counted(labelled(rest), "rest")
        if seen["rows"]:
            in_blocks(rest)
    out = beside(signed, reps.select("f1", "f2", "rep"), ["f1", "f2"], count)
    if state["moved"] is not None:
        out = beside(out, state["moved"], "rep", state["many"]).withColumn("rep", F.coalesce("comp", "rep")).drop("comp")
    out = out.withColumn("grp", F.col("rep"))
    if repeated:
        first = reps.select("rep", "first")
        if state["moved"] is not None:
            first = beside(first, state["moved"], "rep", state["many"]).select(F.coalesce("comp", "rep").alias("rep"), "first")
        out = beside(out, scratch.write(first.groupBy("rep").agg(F.min("first").alias("least")), "firsts"), "rep", count).withColumn("rep", F.col("least"))
    return out.select("id", "n", "f1", "f2", "grp", F.when(F.col("f1").isNull(), F.col("id")).otherwise(F.col("rep")).alias("component"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable), kept (id is component_id)."""
    out = classes(spark, docs, id_col, text_col, k, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: the row with the smallest id, of repeated ids the one whose fingerprint is least; rows that agree in both
    are copies, of which one stays. Rows without words and rows with a null id stay. So no text is lost that is not near one that stays."""
    seen = classes(spark, docs, id_col, text_col, k, percent).where("id is not null and f1 is not null")
    scratch = Scratch(spark, "dedup")
    seen = scratch.write(seen.select("id", "f1", "f2", "grp", "component"), "seen")
    if not seen.groupBy("id").count().where("count > 1").limit(1).count():
        name = unused(docs, "gone")
        gone = seen.where("id <> component").select(F.col("id").alias(name))  # fewer than the kept ones, so that texts are shuffled only where many go
        return docs.join(few(gone, gone.count()), docs[id_col].cast("long") == F.col(name), "left_anti")
    f1, f2, best = (unused(docs, x) for x in ("f1", "f2", "best"))
    stays = scratch.write(seen.groupBy("grp").agg(F.min(F.struct("id", "f1", "f2")).alias("s")).select(F.struct(F.col("s.id").alias("i"), F.col("s.f1").alias("f"), F.col("s.f2").alias("g")).alias(best)), "stays")
    marked = with_fingerprints(docs, text_col, k, (f1, f2))
    kept = marked.where(F.col(f1).isNotNull() & F.col(id_col).isNotNull())
    kept = kept.join(few(stays, stays.count()), F.struct(F.col(id_col).cast("long").alias("i"), F.col(f1).alias("f"), F.col(f2).alias("g")) == F.col(best), "left_semi")
    rest = marked.where(F.col(f1).isNull() | F.col(id_col).isNull())
    return kept.dropDuplicates([id_col, f1, f2]).unionByName(rest).select(*docs.columns)
