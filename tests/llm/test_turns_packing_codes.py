"""Structure repair, packing and vector codes against brute force, and on awkward input."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.llm import packing, queries, turns, vector_codes, word_ids

CONV = "conv_id long, turn long, role string, text string, stands boolean, copies int, initial string, nth int"


def conversations(spark, rows):
    """Extra columns with names that the operator uses within."""
    return spark.createDataFrame([(*r, False, 9, "x", 7) for r in rows], CONV)


def brute_repair(rows):
    """All edits of all turns with all inserts of up to two between, for one conversation of (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    between = ["", "u", "a", "ua", "au"]
    best = None
    for edits in itertools.product(*(["D"] if f in ("blank", "duplicate") else ["K", "u", "a", "D"] for f in faults)):
        for gaps in itertools.product(between, repeat=len(rows) + 1):
            roles, audit, cost, kept = "", "", 0, []
            for i in range(len(rows) + 1):
                for g in gaps[i]:
                    roles, audit, cost = roles + g, audit + "I", cost + 3
                    kept.append(("user" if g == "u" else "assistant", ""))
                if i < len(rows):
                    e = edits[i]
                    audit += e if e in "KD" else "R"
                    cost += {"K": 0, "D": 4}.get(e, 3) + (3 if e != "D" and faults[i] == "truncated" else 0)
                    if e != "D":
                        role = {"u": "user", "a": "assistant"}.get(e, rows[i][1])
                        roles += role[:1] or "-"
                        kept.append((role, rows[i][2]))
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)
    numbers = {r[0] for r in rows} - {None}
    pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), pairs, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def test_repair_against_all_edits(spark):
    rng = np.random.default_rng(5)
    texts = ["one.", "two!", "cut", " ", "", "so?\n", "tail. "]
    rows = []
    for c in range(70):
        for _ in range(rng.integers(0, 4)):
            rows.append((c, None if rng.random() < 0.1 else int(rng.integers(0, 6)), str(rng.choice(["user", "assistant", "system", "tool", ""], p=[0.4, 0.3, 0.15, 0.1, 0.05])), str(rng.choice(texts))))
    found = {r.conv_id: tuple(r)[1:] for r in turns.repair(conversations(spark, rows)).withColumn("sha", turns.digest(F.col("repaired"))).drop("repaired").collect()}
    by = defaultdict(list)
    for c, *r in rows:
        by[c].append(tuple(r))
    assert found == {c: brute_repair(r) for c, r in by.items()}
    assert len({f[6] for f in found.values()}) > 20


def test_damage_is_by_the_checksum_of_conversation_and_turn(spark):
    rows = [(c, t, "assistant", "A. b? c!") for c in range(20) for t in range(10)] + [(None, None, None, None), (3, None, "user", None)]
    got = {(r.conv_id, r.turn): (r.role, r.text, r.copies) for r in turns.damage(conversations(spark, rows)).collect()}
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        assert got[c, t] == ("user" if case == 4 else role, "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text, {0: 0, 3: 2}.get(case, 1))


def test_repair_of_awkward_conversations(spark):
    long = [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)]
    rows = [*long, (2, 0, None, None), (None, 5, "user", "a."), (None, 6, "user", "a."), (4, 0, "system", "s.")]
    got = {r.conv_id: r for r in turns.repair(conversations(spark, rows)).collect()}
    assert (got[1].cost, got[1].audit, len(got[1].repaired)) == (0, "K" * 3000, 3000)
    assert (got[2].blank, got[2].cost, got[2].audit, got[2].repaired) == (1, 4, "D", [])
    assert (got[None].duplicate, got[None].audit, [r.role for r in got[None].repaired]) == (1, "KDI", ["user", "assistant"])
    assert (got[4].cost, got[4].audit) == (4, "D")
    none = turns.repair(conversations(spark, rows).withColumn("copies", F.lit(0)), "copies").withColumn("sha", turns.digest(F.col("repaired")))
    assert {tuple(r)[1:8] for r in none.collect()} == {(0, 0, 0, 0, 0, 0, "")} and {r.sha for r in none.collect()} == {hashlib.sha256(b"").hexdigest()}
    assert turns.repair(conversations(spark, rows).limit(0)).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_encoder():
    with open(queries.word_tokenizer(), encoding="utf-8") as f:
        return word_ids.encoder(f.read())


def test_ids_are_those_of_the_library(word_encoder):
    rng = np.random.default_rng(7)
    letters = list("abst'redlvm'S TV\n\t\u0085éÉßİǅΣσ12²½ª.,!<|>«»’–€​ ñ\x1c\x00\x7f中ﬁ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(5000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} '{chr(c)}" for c in range(0x2100)] + ["it's we'll ''s 5's '", "<|endoftext|> x <|startoftext|>", "", "word " * 100_000, "é" * 50_000, "é"]
    assert word_encoder.fast
    want = [x.ids for x in word_encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in word_encoder.encode(texts)] == want
    word_encoder.runs.clear(2)  # a small table that has to grow
    assert [x.tolist() for x in word_encoder.encode(texts[:300])] == want[:300]


def test_other_tokenizers_are_run_by_the_library():
    with open(queries.default_tokenizer(), encoding="utf-8") as f:
        other = word_ids.encoder(f.read())
    assert not other.fast
    assert other.encode(["It's <|endoftext|> 12"])[0].tolist() == other.library.encode("It's <|endoftext|> 12", add_special_tokens=False).ids


def _check_packed(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def test_packing_of_awkward_documents(spark, word_encoder):
    texts = [(0, None), (1, ""), (2, "one"), (2, "one"), (2, "other words"), (None, "no id"), (4, "many words " * 20_000), (5, "it's " * 4095), (6, "and so on " * 700)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts], "doc_id long, text string, length int, ids string, row int")
    made = packing.pieces(spark, docs, queries.word_tokenizer())
    whole = defaultdict(list)
    for r in made.collect():
        whole[r.doc_id].append(r)
    for i, t in texts:
        ids = [*word_encoder.library.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(j, lo, np.array(ids[lo : lo + 4096], "<u4").tobytes()) for j, lo in enumerate(range(0, len(ids), 4096))]
        assert all((j, lo, ids) in [(r.piece, r.start, bytes(r.ids)) for r in whole[i]] for j, lo, ids in want)
    assert sum(map(len, whole.values())) == sum(-(-(len(word_encoder.encode([t or ""])[0]) + 1) // 4096) for _, t in texts)
    packed = packing.pack(spark, made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))).collect()
    assert _check_packed(packed, 4096) == -(-sum(r.length for r in packed) // 4096)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == Counter((r.doc_id, r.piece, zlib.crc32(r.ids)) for rows in whole.values() for r in rows)
    out = packing.sequences(spark, made).collect()
    assert sum(r.n_tokens for r in out) == sum(r.length for r in packed) and max(r.n_tokens for r in out) == 4096
    assert Counter(bytes(r.ids)[4 * s.offset : 4 * (s.offset + s.length)] for r in out for s in r.spans) == Counter(bytes(r.ids) for rows in whole.values() for r in rows)
    assert packing.pack(spark, packing.pieces(spark, docs.limit(0), queries.word_tokenizer()).drop("ids")).count() == 0


def test_groups_are_dealt_again_until_few_gaps_are_left(spark):
    rng = np.random.default_rng(3)
    lengths = [int(n) for n in np.minimum(4096, rng.lognormal(6.3, 1.1, 4000) + 1)]
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "part long, length long")
    rows = packing.pack(spark, parts, group=150).collect()
    assert sorted((r.part, r.length) for r in rows) == sorted(enumerate(lengths))
    used, least = _check_packed(rows, 4096), -(-sum(lengths) // 4096)
    assert used <= least * 1.005 + 1, (used, least)


@pytest.mark.parametrize("low, high, n, saved", [(1000, 2100, 2000, 20), (700, 1400, 2000, 10), (1200, 3000, 1000, 0), (1, 4095, 1500, 0)])
def test_local_search_saves_sequences_and_keeps_all(low, high, n, saved):
    lengths = [int(x) for x in np.random.default_rng(1).integers(low, high, n)]
    bins = packing.Bins(lengths, 4096)
    bins.best_fit()
    before, squares = len(bins.held), sum(f * f for f in bins.fill)
    bins.improve()
    assert sum(f * f for f in bins.fill) >= squares
    assert sorted(i for h in bins.held for i in h) == list(range(n))
    assert all(sum(lengths[i] for i in h) == f <= 4096 for h, f in zip(bins.held, bins.fill, strict=True))
    assert before - sum(f > 0 for f in bins.fill) >= saved


def test_few_rests_are_packed_as_well_as_can_be():
    """Against all ways to share out up to seven rests."""

    def least(lengths):
        def share(rest, rooms):
            if not rest:
                return len(rooms)
            ways = [share(rest[1:], [*rooms, 10 - rest[0]])] + [share(rest[1:], [*rooms[:i], r - rest[0], *rooms[i + 1 :]]) for i, r in enumerate(rooms) if r >= rest[0]]
            return min(ways)

        return share(lengths, [])

    rng = np.random.default_rng(2)
    worse = 0
    for _ in range(150):
        lengths = [int(x) for x in rng.integers(1, 10, rng.integers(0, 8))]
        worse += sum(f > 0 for f in packing.pack_lengths(lengths, 10).fill) - least(lengths)
    assert worse <= 2


# --- vector codes -----------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, row long, pos int, part string"


def brute_codes(rows):
    kept = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 8)
    cut = lambda v: [(v + [0] * (8 * width - len(v)))[p * width : (p + 1) * width] for p in range(8)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v)[p] for _, v, _ in kept[:16]] for p in range(8)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(cut(v)[p], books[p])[1]].append(cut(v)[p])
            for j, held in own.items():
                books[p][j] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    out, labels = [], Counter()
    for i, v, label in kept:
        best = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
        labels[label] += out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, err, labels[label], sha) for i, label, code, err in out), key=repr)


def codes_of(spark, rows):
    coded, books = vector_codes.compress(spark, spark.createDataFrame([(*r, 1, 2, "z") for r in rows], VEC))
    return sorted(((r.vec_id, r.code, r.error, r.label_error, vector_codes.books_digest(books)) for r in vector_codes.label_errors(spark, coded).collect()), key=repr)


def test_codes_against_plain_lloyd(spark):
    rng = np.random.default_rng(4)
    vector = lambda: [float(x) for x in np.float32(rng.normal(0, 0.2, 16))]
    often = vector()
    rows = [(i, often if i % 3 == 0 else [often[0], *vector()[1:]] if i % 3 == 1 else vector(), int(rng.integers(0, 3)) if i % 7 else None) for i in range(120)]
    rows += [(200, None, 1), (201, [float("nan")] * 16, 1), (202, [float("inf"), *often[1:]], 1), (203, [None, *often[1:]], 2), (5, vector(), 1), (5, vector(), 1), (5, rows[5][1], 1), (None, vector(), None), (300, often[:9], 0), (301, [], 2), (302, [0.0] * 16, None)]
    assert codes_of(spark, rows) == brute_codes(rows)


def test_codes_of_few_or_no_vectors(spark):
    few = [(3, [0.5] * 8, 1), (1, [-0.25] * 8, None), (2, [0.1] * 8, 1)]
    assert codes_of(spark, few) == brute_codes(few)
    huge = [(i, [(-1.0) ** i * 3e38] * 8, 1) for i in range(20)]
    assert {r[2] for r in codes_of(spark, huge)} == {0}
    assert codes_of(spark, []) == [] and codes_of(spark, [(1, None, 1), (2, [None], 1)]) == []
    assert len(codes_of(spark, [(1, [], 1)])) == 1


def test_a_text_dense_in_notices_is_scanned_in_proportion(spark):
    """Windows are told apart by number and their bands made within the row; with structs 20,000 words took seven times 5,000."""
    from vellumine.llm import license_scan

    line = license_scan.TEMPLATES["MIT notice"] + "\n"

    def seconds(n):
        df = spark.createDataFrame([(1, line * (n // len(line.split())))], "doc_id long, text string")
        began = time.perf_counter()
        assert [(r.template, r.containment, r.first_word) for r in license_scan.scan(spark, df).collect()] == [("MIT notice", 1.0, 0)]
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 6 * max(seconds(10_000), 2)
