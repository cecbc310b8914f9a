"""Byte-level BPE encoding and decoding with forced-boundary splitting.

Merges never make a pair of neighbouring bytes that stands inside no vocabulary token, so a text of one pre-token can be cut
between the bytes of each such pair. The fragments are encoded independently and the ids concatenated; fragments and
pre-tokens repeat, so their ids are kept in a bounded table. Merges are applied here, by rank; long fragments by a heap, so time is n log n.
The tokenizer file is a parameter, read by the driver and sent to the executors; its model must be byte-level BPE without normaliser, prefix space,
dropout, unknown token, affixes, byte fallback or post-processor, and its added tokens plain strings: others are refused.

Cases: null or empty text: no ids; digests of zero bytes. Strings of added tokens in a text become those tokens, as the
tokenizers library does by default. Repeated rows are encoded each; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.plans.scratch import ship

#: Fixed: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 600_000
#: Fragments of more letters are merged by a heap, and not kept.
LONG = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec(dict):
    """Pre-token -> its ids as little-endian 32-bit integers; filled on demand, emptied when it holds KEPT."""

    def __init__(self, content: str):
        import regex

        spec = json.loads(content)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not spec["normalizer"] and not spec["post_processor"]
        odd = [x for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(x)]
        if not plain or odd or any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"the tokenizer is not plain byte-level BPE {odd}")
        self.find = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        back = {c: b for b, c in self.letters.items()}
        self.ids = model["vocab"]
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.inside = {x + y for token in self.ids for x, y in zip(token, token[1:])}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in self.ids.items()}
        self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in spec["added_tokens"]}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.fragments: dict[str, bytes] = {}

    def cuts(self, letters: str) -> list[str]:
        """The fragments between forced boundaries."""
        inside = self.inside
        at = [i for i in range(1, len(letters)) if letters[i - 1 : i + 1] not in inside]
        return [letters[lo:hi] for lo, hi in zip([0, *at], [*at, len(letters)])] if at else [letters]

    def merged(self, letters: str) -> list[str]:
        """The tokens of a fragment: the pair of least rank is merged first, of equal pairs the leftmost."""
        parts, ranks, never = list(letters), self.ranks, len(self.ranks)
        if len(parts) > LONG:
            return self.merged_by_heap(parts)
        rank = [ranks.get(pair, never) for pair in zip(parts, parts[1:])]
        while rank and (best := min(rank)) < never:
            i = rank.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = ranks.get((parts[i - 1], parts[i]), never)
            if i < len(rank):
                rank[i] = ranks.get((parts[i], parts[i + 1]), never)
        return parts

    def merged_by_heap(self, parts: list) -> list[str]:
        n, ranks = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j < 0 or parts[j] != y:
                continue  # merged since
            parts[i], parts[j] = x + y, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for lo, hi in ((before[i], i), (i, after[i])):
                if lo >= 0 and hi >= 0 and (pair := (parts[lo], parts[hi])) in ranks:
                    heapq.heappush(heap, (ranks[pair], lo, *pair))
        return [p for p in parts if p is not None]

    def fragment(self, letters: str) -> bytes:
        if (found := self.fragments.get(letters)) is None:
            found = b"".join(self.ids[t].to_bytes(4, "little") for t in self.merged(letters))
            if len(self.fragments) >= KEPT:
                self.fragments.clear()
            if len(letters) <= LONG:
                self.fragments[letters] = found
        return found

    def __missing__(self, token: str) -> bytes:
        letters = "".join(map(self.letters.__getitem__, token.encode()))
        ids = b"".join(map(self.fragment, self.cuts(letters)))
        if len(self) >= KEPT:
            self.clear()
        if len(token) <= 64:
            self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.split and any(a in text for a in self.added):
            return b"".join(self.added[part] if i % 2 else b"".join(map(self.__getitem__, self.find(part))) for i, part in enumerate(self.split(text)))
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(content: str) -> Codec:
    return Codec(content)


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and, as asked in outputs: ids array<int>, decoded string, ids_sha256 and decoded_sha256 (lower-case hex)."""
    ship(spark)
    with open(path, encoding="utf-8") as f:
        content = f.read()
    codec(content)  # refused here, if at all
    shared = spark.sparkContext.broadcast(content)
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}

    def run(batches):
        own = codec(shared.value)
        for b in batches:
            rows = {name: [] for name in ("n_tokens", *outputs)}
            for text in b.column(1):
                ids = own.encode(text.as_py() or "")
                rows["n_tokens"].append(len(ids) // 4)
                if "ids" in rows:
                    rows["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                if "ids_sha256" in rows:
                    rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                if "decoded" in rows or "decoded_sha256" in rows:
                    text = own.decode(ids)
                    if "decoded" in rows:
                        rows["decoded"].append(text)
                    if "decoded_sha256" in rows:
                        rows["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            made = [pa.array(rows[name], pa.int64() if name == "n_tokens" else kinds[name][1]) for name in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *made], ["id", *rows])

    schema = "id long, n_tokens long" + "".join(f", {name} {kinds[name][0]}" for name in outputs)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
