"""Byte-pair merges over NumPy arrays: many words at once, by the rules of a public vocabulary file."""

from __future__ import annotations

import json

import numpy as np

NEVER = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Vocabulary and merges of a JSON file; a suffix that marks the end of a word is honoured."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.size = size = max(max(vocab.values()), *self.special.values()) + 1
        self.byte_id = np.zeros(256, np.int64)
        self.last_byte_id = np.zeros(256, np.int64)
        for c, b in byte_alphabet().items():
            self.byte_id[b], self.last_byte_id[b] = vocab[c], vocab[c + suffix]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.made_at = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for rank, (a, b) in enumerate(pairs):
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            merges.setdefault((a, b), (rank, made))
            if self.made_at[made] < 0:
                self.made_at[made], self.left[made], self.right[made] = rank, a, b
        keys = np.fromiter((a * size + b for a, b in merges), np.int64, len(merges))
        ranks = np.fromiter((r for r, _ in merges.values()), np.int64, len(merges))
        self.merge_makes = np.zeros(len(pairs), np.int64)
        self.merge_makes[ranks] = np.fromiter((m for _, m in merges.values()), np.int64, len(merges))
        order = np.argsort(keys)
        self.merge_keys, self.merge_ranks = keys[order], ranks[order]
        # A table of one slot for each hash for fast look-ups; pairs that share a slot are searched for in merge_keys.
        self.slot_key, self.slot_rank = np.full(1 << 20, -1, np.int64), np.full(1 << 20, NEVER)
        slot = (((keys // size) * 0x9E3779B1 + (keys % size) * 0x85EBCA77) >> 7) & (len(self.slot_key) - 1)
        self.slot_key[slot], self.slot_rank[slot] = keys, ranks
        self.slot_full = np.bincount(slot, minlength=len(self.slot_key)) > 1

    def exact(self, word: bytes) -> list[int]:
        """Plain BPE of one word of any length: every place of the lowest-ranked pair merges, left to right, again and again."""
        flat = np.frombuffer(word, np.uint8)
        parts = self.byte_id[flat]
        parts[-1:] = self.last_byte_id[flat[-1:]]
        while len(parts) > 1:
            ranks = self._ranks(parts[:-1], parts[1:])
            low = ranks.min()
            if low == NEVER:
                break
            at = np.flatnonzero(ranks == low)
            if (parts[at[0]] == parts[at[0] + 1]) and len(at) > 1:  # in a run of one symbol only every other place merges
                run = np.cumsum(np.diff(at, prepend=-9) != 1)
                at = at[(np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0]
            parts[at] = self.merge_makes[low]
            parts = np.delete(parts, at + 1)
        return parts.tolist()

    def exact_many(self, words: list[bytes]) -> list[bytes]:
        """Plain BPE of many words at once: each round merges the lowest-ranked leftmost pair of every word."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 8), (9, 12), (13, 16), (17, 32)):
            mine = np.flatnonzero((lengths >= low) & (lengths <= high))
            if not len(mine):
                continue
            flat = np.frombuffer(b"".join(words[i].ljust(high, b"\0") for i in mine.tolist()), np.uint8)
            inside = np.arange(high) < lengths[mine, None]
            flat, last = flat.reshape(-1, high), lengths[mine] - 1
            parts = np.where(inside, self.byte_id[flat], -1)
            parts[np.arange(len(mine)), last] = self.last_byte_id[flat[np.arange(len(mine)), last]]
            ranks = np.full(parts.shape, NEVER)
            ranks[:, :-1] = self._ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(mine), high - 1)
            rows = np.arange(len(mine))
            while len(rows):
                at = ranks[rows].argmin(1)
                best = ranks[rows, at]
                rows, at, best = (x[best < NEVER] for x in (rows, at, best))
                p, r = parts[rows], ranks[rows]
                gone = np.arange(high)[None, :] > at[:, None]
                p[:, :-1] = np.where(gone[:, :-1], p[:, 1:], p[:, :-1])
                r[:, :-1] = np.where(gone[:, :-1], r[:, 1:], r[:, :-1])
                p[:, -1], r[:, -1] = -1, NEVER
                k = np.arange(len(rows))
                p[k, at] = self.merge_makes[best]
                r[k, at] = self._ranks(p[k, at], np.where(at + 1 < high, p[k, np.minimum(at + 1, high - 1)], -1))
                left = np.flatnonzero(at > 0)
                r[left, at[left] - 1] = self._ranks(p[left, at[left] - 1], p[left, at[left]])
                parts[rows], ranks[rows] = p, r
            sizes = (parts >= 0).sum(1)
            packed, cut = parts[parts >= 0].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * 4
            for i, a, b in zip(mine.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                out[i] = packed[a:b]
        for i in np.flatnonzero(lengths > 32).tolist():
            out[i] = np.array(self.exact(words[i]), "<u4").tobytes()
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NEVER where the pair does not merge or a side is missing (-1)."""
        slot = ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) & (len(self.slot_key) - 1)
        key = a * self.size + b
        ranks = np.where(self.slot_key[slot] == key, self.slot_rank[slot], NEVER)
        again = np.flatnonzero(self.slot_full[slot] & (ranks == NEVER))
        if len(again):
            at = np.minimum(np.searchsorted(self.merge_keys, key[again]), len(self.merge_keys) - 1)
            ranks[again] = np.where(self.merge_keys[at] == key[again], self.merge_ranks[at], NEVER)
        ranks[(a < 0) | (b < 0)] = NEVER
        return ranks


def spread(packed: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words in turn, given the ids of each distinct word and which word stands where; and the end of each word."""
    lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    pool, first = np.frombuffer(b"".join(packed), "<u4"), np.cumsum(lengths) - lengths
    each = lengths[index]
    ends = np.cumsum(each)
    if not len(ends):
        return pool[:0], ends
    return pool[np.repeat(first[index] - ends + each, each) + np.arange(ends[-1])], ends
