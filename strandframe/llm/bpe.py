"""Byte-level BPE encoding and decoding by speculation and verification.

Each distinct word of a batch is first cut greedily into the longest vocabulary entries. That proposal is the true BPE
result exactly when every token is its own encoding and no adjacent pair would have merged across its border; the
second condition is tested for all pairs at once with NumPy. Only words that fail it are merged exactly.

The border test. While BPE runs, the symbol left of a border is one of the right-edge descendants of the left token:
descendant ``i`` exists from the rank that makes it until the rank that makes its parent. The same holds on the right
with left-edge descendants. A merge across the border of rank ``m`` between descendants that live at the same time
happens if it comes before both parents (ties go to the leftmost pair). A pair is compatible if no such merge exists.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .base import tokenizer_path
from .merges import NEVER, MergeTable, byte_alphabet, spread

#: Fixed values of the byte-level vocabulary format: the pre-tokenising pattern and the special token.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"

#: Words kept in a worker's cache before it is emptied, and characters handled at once. Both only bound memory.
CACHE_WORDS = 400_000
CHUNK_CHARS = 4_000_000
#: A single longer word (a text without any break) is encoded on its own and not cached.
CACHED_WORD_CHARS = 256


class SpeculativeBpe(MergeTable):
    """Encoder and decoder over one byte-level vocabulary file (JSON with ``vocab`` and ``merges``)."""

    def __init__(self, path: str):
        super().__init__(path)
        of = byte_alphabet()
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in self.vocab.items():
            self.token_bytes[i] = bytes(of[c] for c in token)
        self.automaton = ahocorasick.Automaton()
        for i in self.vocab.values():
            self.automaton.add_word(self.token_bytes[i].decode("latin-1"), (i, len(self.token_bytes[i])))
        self.automaton.make_automaton()
        alone = self.exact_many(self.token_bytes)
        self.stable = np.fromiter((alone[i] == np.array([i], "<u4").tobytes() for i in range(self.size)), bool, self.size)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.decimal = [b"%d," % i for i in range(self.size)]
        self.right_edge, self.left_edge = self._edges(self.right), self._edges(self.left)
        self.pairs_known, self.pairs_good = np.empty(0, np.int64), np.empty(0, bool)
        self.cache: dict[str, bytes] = {}
        self.failed = self.proposed = 0
        self.find = regex.compile(PATTERN).findall
        # Characters that are newer than the tokenizer's Unicode tables, by this Python's own; see split().
        newer = [c for c in range(0x500, 0x110000) if unicodedata.category(chr(c)) in ("Cn", "Cs")]
        starts = [c for c, before in zip(newer, [-1, *newer]) if c != before + 1]
        stops = [c for c, after in zip(newer, [*newer[1:], -1]) if c != after - 1]
        self.unsure = regex.compile("[%s]" % "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, stops))).search
        self.library = Tokenizer.from_file(path)

    @staticmethod
    def _edges(child: np.ndarray) -> list[np.ndarray]:
        """Row k: for each token, its k-th descendant along one edge (-1 past a single byte)."""
        rows = [np.arange(len(child))]
        while (rows[-1] >= 0).any():
            rows.append(np.where(rows[-1] >= 0, child[rows[-1]], -1))
        return rows[:-1]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether BPE of their joined bytes leaves the border between them alone."""
        good = self.stable[a] & self.stable[b]
        until_a = np.full(len(a), NEVER)
        for edge_a in self.right_edge:
            x = edge_a[a]
            live = x >= 0
            if not live.any():
                break
            from_a = np.where(live, self.made_at[x], 0)
            until_b = np.full(len(b), NEVER)
            for edge_b in self.left_edge:
                y = edge_b[b]
                both = live & (y >= 0)
                if not both.any():
                    break
                from_b = np.where(y >= 0, self.made_at[y], 0)
                meet = np.flatnonzero(both & (np.maximum(from_a, from_b) < np.minimum(until_a, until_b)))
                rank = self._ranks(x[meet], y[meet])
                good[meet[(rank < NEVER) & (rank < until_a[meet]) & (rank <= until_b[meet])]] = False
                until_b = np.where(y >= 0, from_b, until_b)
            until_a = np.where(live, from_a, until_a)
        return good

    def _pairs_ok(self, codes: np.ndarray) -> np.ndarray:
        """Compatibility by pair code, each distinct pair worked out once in a worker's life."""
        distinct, back = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.pairs_known, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.pairs_known)
        known[inside] = self.pairs_known[at[inside]] == distinct[inside]
        if not known.all():
            new = distinct[~known]
            if len(self.pairs_known) > 4_000_000:
                self.pairs_known, self.pairs_good = np.empty(0, np.int64), np.empty(0, bool)
                new = distinct
            keys = np.concatenate([self.pairs_known, new])
            good = np.concatenate([self.pairs_good, self.compatible(new // self.size, new % self.size)])
            order = np.argsort(keys, kind="stable")
            self.pairs_known, self.pairs_good = keys[order], good[order]
        return self.pairs_good[np.searchsorted(self.pairs_known, distinct)][back]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit values."""
        raw = [w.encode("utf-8", "replace") for w in words]
        joined = "￿".join(w.decode("latin-1") for w in raw)
        found = [(end, *value) for end, value in self.automaton.iter_long(joined)]
        if not found:
            return [b""] * len(words)
        ends, ids, sizes = (np.array(x, np.int64) for x in zip(*found))
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths + 1) - lengths - 1
        owner = np.searchsorted(starts, ends, side="right") - 1
        ok = np.ones(len(words), bool)
        ok[owner[~self.stable[ids]]] = False
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        codes = ids[inner] * self.size + ids[inner + 1]
        ok[owner[inner[~self._pairs_ok(codes)]]] = False
        ok &= np.bincount(owner, sizes, len(words)).astype(np.int64) == lengths  # the proposal covers the word
        packed, cut = ids.astype("<u4").tobytes(), np.searchsorted(owner, np.arange(len(words) + 1)) * 4
        failing = np.flatnonzero(~ok).tolist()
        self.proposed += len(words)
        self.failed += len(failing)
        cut = cut.tolist()
        out = [packed[a:b] for a, b in zip(cut, cut[1:])]
        for i, ids in zip(failing, self.exact_many([raw[i] for i in failing])):
            out[i] = ids
        return out

    def _segments(self, text: str) -> Iterator[str]:
        """The text between special tokens, and these tokens themselves."""
        if SPECIAL not in text:
            yield text
            return
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                yield SPECIAL
            yield part

    def split(self, text: str) -> list[str]:
        """Pre-tokens. Unassigned code points may be letters to one Unicode version only: the library splits texts with them."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.unsure(text):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def words(self, text: str) -> list[str]:
        return [w for s in self._segments(text) for w in ([s] if s in self.special else self.split(s))]

    def encode_batch(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Token ids of each text, in order; memory is bounded by CHUNK_CHARS and the longest text."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            held.append(self.words(text))
            chars += len(text)
            if chars >= CHUNK_CHARS:
                yield from self._flush(held)
                held, chars = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for token, i in self.special.items():
            self.cache[token] = np.array([i], "<u4").tobytes()
        coded = pa.array([w for words in held for w in words], pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.cache.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self.encode_words([distinct[i] for i in missing])):
            found[i] = ids
            if len(distinct[i]) <= CACHED_WORD_CHARS:
                self.cache[distinct[i]] = ids
        ids, ends = spread(found, coded.indices.to_numpy())
        ends = np.concatenate([[0], ends])[np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))]
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            yield ids[a:b]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> SpeculativeBpe:
    """One encoder for each worker process and vocabulary."""
    return SpeculativeBpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: columns ``doc_id`` and ``ids`` (array of int). One narrow stage, no shuffle.

    Null texts count as empty and have no ids; repeated rows give repeated results; a null id stays null; further
    columns of the input are not read. A text may hold the special token's string, which becomes its one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            ids = [x.astype(np.int32) for x in bpe.encode_batch(t or "" for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each array of ids: columns ``doc_id`` and ``text``. A null array gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bpe_encode`` and ``bpe_decode`` in one pass that returns digests in place of long arrays.

    Columns: doc_id, n_tokens long, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (UTF-8).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            rows = []
            for ids in bpe.encode_batch(t or "" for t in batch.column(1).to_pylist()):
                listed = ids.tolist()
                decimals = b"".join(map(bpe.decimal.__getitem__, listed))[:-1]
                decoded = bpe.decode(listed).encode()
                rows.append((len(listed), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            n, ids_sha, decoded_sha = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def byte_bpe_path() -> str:
    return tokenizer_path("byte_bpe_50k.json")
