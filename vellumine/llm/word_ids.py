"""Token ids of many texts at once by a tokenizers file, as the tokenizers library gives them.

Files whose normaliser is NFC, white space to a space and lower case, and whose tokens never reach beyond a run of letters, a digit or a run of other signs (BPE with word ends), are run fast: such runs are found in whole blocks of text as arrays of code
points, known runs are looked up by a 64-bit hash, and the library encodes each new run once. What the library makes of a code point (its lower case, and whether it is a letter, a digit, white space or none of these) is asked from the
library itself. Texts with code points outside the asked ones or with strings of added tokens, and all texts of other files, are encoded whole by the library.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from vellumine.llm.textnum import hashes

#: Fixed: the pattern of runs for which the fast way is right.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points that are asked for: Latin letters, general punctuation and the euro sign.
ASKED = (*range(1, 0x250), *range(0x2010, 0x2060), 0x20AC)
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = 0, 1, 2, 3, 4
#: Letters of a block, and runs that are kept; beyond it all are forgotten.
BLOCK, KEPT = 1 << 20, 1 << 21
#: New runs in one call of the library.
CALL = 4096


class Runs:
    """Hash of a run -> its ids, as an open table over arrays."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.keys, self.values, self.mask = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), (1 << bits) - 1
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each run, -1 if unknown."""
        out = np.full(len(h), -1, np.int32)
        left, slot = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            value = self.values[slot]
            hit = (value >= 0) & (self.keys[slot] == h[left])
            out[left[hit]] = value[hit]
            on = (value >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def _place(self, h: np.ndarray, value: np.ndarray) -> None:
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        while len(h):
            free = self.values[slot] < 0
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.values[slot[one]] = h[one], value[one]
            rest = np.ones(len(h), bool)
            rest[one] = False
            h, value, slot = h[rest], value[rest], slot[rest]
            taken = self.keys[slot] != h
            slot = np.where((self.values[slot] >= 0) & taken, (slot + 1) & self.mask, slot)

    def add(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New, distinct hashes; ids of all, one run's after the other's."""
        n = len(self.first)
        if 2 * (n + len(h)) > self.mask:
            known = np.flatnonzero(self.values >= 0)
            keys, values = self.keys[known], self.values[known]
            size = 1 << (2 * (n + len(h))).bit_length() + 1
            self.keys, self.values, self.mask = np.zeros(size, np.uint64), np.full(size, -1, np.int32), size - 1
            self._place(keys, values)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        self._place(h, np.arange(n, n + len(h), dtype=np.int32))

    def gather(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs in a row, and where each run's begin (one more at the end)."""
        n = self.count[runs]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(self.first[runs] - ends[:-1], n) + np.arange(ends[-1])], ends


class Encoder:
    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_padding()
        self.library.no_truncation()
        made = json.loads(content)
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        self.fast = self._known(made)
        if self.fast:
            self.runs = Runs()
            vocab = made["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
            self._ask()

    def _known(self, made: dict) -> bool:
        model, steps = made["model"], lambda x, name: (x or {}).get(name) or []
        lower = [s.get("type") for s in steps(made.get("normalizer"), "normalizers")] == ["NFC", "Replace", "Lowercase"]
        split = steps(made.get("pre_tokenizer"), "pretokenizers")
        runs = [s.get("type") for s in split] == ["Split", "ByteLevel"] and split[0]["pattern"].get("Regex") == PATTERN and split[0]["invert"] and split[0]["behavior"] == "Removed"
        plain = not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in made.get("added_tokens") or [])
        plain = plain and not (made.get("post_processor") or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"))
        return bool(lower and runs and plain and not split[1]["add_prefix_space"] and not split[1]["use_regex"] and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and made["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"})

    def _ask(self) -> None:
        """What the library makes of each code point."""
        norm, split = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        self.lower, self.kind = np.zeros(max(ASKED) + 1, np.uint32), np.full(max(ASKED) + 1, UNKNOWN, np.uint8)
        for c in ASKED:
            small = norm(chr(c))
            if len(small) != 1 or small != " " and norm(f"a{chr(c)}a") != f"a{small}a":
                continue
            among = len(split(f"a{small}a"))
            self.lower[c] = ord(small)
            self.kind[c] = SPACE if small == " " else LETTER if among == 1 else OTHER if len(split(f"!{small}!")) == 1 else DIGIT if among == 3 else UNKNOWN

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens."""
        out: list = [None] * len(texts)
        block, size = [], 0
        for i, text in enumerate(texts):
            if not self.fast or any(t in text for t in self.added):
                out[i] = self._whole(text)
                continue
            block.append(i)
            size += len(text)
            if size >= BLOCK:
                self._block(texts, block, out)
                block, size = [], 0
        if block:
            self._block(texts, block, out)
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _block(self, texts: list[str], block: list[int], out: list) -> None:
        size = np.array([len(texts[i]) for i in block], np.int64)
        begin = np.cumsum(size + 1) - size - 1  # a line feed after each text
        c = np.frombuffer("".join(f"{texts[i]}\n" for i in block).encode("utf-32-le"), np.uint32)
        kind = self.kind[np.minimum(c, len(self.kind) - 1)]
        kind[c >= len(self.kind)] = UNKNOWN
        if (kind == UNKNOWN).any():
            bad = np.unique(np.searchsorted(begin, np.flatnonzero(kind == UNKNOWN), "right") - 1)
            for j in bad:
                out[block[j]] = self._whole(texts[block[j]])
            rest = [i for j, i in enumerate(block) if j not in set(bad.tolist())]
            if rest:
                self._block(texts, rest, out)
            return
        c = self.lower[c]
        starts, ends = self._spans(c, kind)
        runs = self._numbers(c, starts, ends)
        ids, places = self.runs.gather(runs)
        cut = places[np.searchsorted(starts, np.append(begin, len(c)))]
        for j, i in enumerate(block):
            out[i] = ids[cut[j] : cut[j + 1]]

    @staticmethod
    def _spans(c: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs; the last code point is white space."""
        inside = kind != SPACE
        start = inside.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        far = np.concatenate([c, [0, 0]])
        quote = np.flatnonzero((c[:-1] == 39) & start[:-1] & (kind[1:] == LETTER))
        a, b = far[quote + 1], far[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[after[kind[after] == LETTER]] = True
        last = inside.copy()
        last[:-1] &= ~inside[1:] | start[1:]
        return np.flatnonzero(start), np.flatnonzero(last) + 1

    def _numbers(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = hashes(c, starts, ends)
        runs = self.runs.find(h)
        new = np.flatnonzero(runs < 0)
        if not len(new):
            return runs
        if len(self.runs.first) > KEPT:
            self.runs.clear()
            new = np.arange(len(h))
        keys, at = np.unique(h[new], return_index=True)
        words = [c[s:e].tobytes().decode("utf-32-le") for s, e in zip(starts[new[at]], ends[new[at]], strict=True)]
        for lo in range(0, len(words), CALL):
            some = words[lo : lo + CALL]
            ids = self._whole(" ".join(some))
            end = np.flatnonzero(self.ends[ids]) + 1
            count = np.diff(end, prepend=0)
            if len(count) != len(some):  # not so with any known file: a token inside a run that looks like its end
                each = [self._whole(w) for w in some]
                ids, count = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            self.runs.add(keys[lo : lo + CALL], ids, count)
        return self.runs.find(h)


@lru_cache(2)
def encoder(content: str) -> Encoder:
    return Encoder(content)
