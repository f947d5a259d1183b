"""Periodic runs of words: stretches that repeat a short sequence of words over and over.

A run is a stretch in which words ``period`` places apart are identical, that no neighbouring word extends, with a length of
at least ``exponent`` periods. Each task works through its texts, many at a time:

1. Words that occur too rarely in their stretch can't be in a run (each word of a period occurs once per repetition), so
   they cut texts into stretches. This is repeated on the stretches; it is exact and leaves little of ordinary prose.
2. The stretches, each closed by a mark of its own, form one sequence. Prefix doubling, which sorts only what is still tied,
   gives its suffix array; the ranks of each doubling tell whether two substrings of a power of two words are equal, so
   any two places can be extended to the right or left in a logarithmic number of array operations.
3. Suffix array and LCP array give the longest previous factor of every place: the nearest smaller places on either side in
   the suffix array are found by pointer jumping, which carries the least LCP on the way.
4. Longest previous factors cut the sequence into LZ blocks. A run that isn't strictly inside a block touches the border of
   a block that holds a bounded share of it; for every border and every period in question, extending to both sides
   from the border (Main) gives these runs.
5. A run strictly inside a block is a copy of an earlier one: blocks are taken from left to right, and runs inside a block's
   source, found by their start, are shifted into the block.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import whole_text

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
EXPONENT = 4
SHORTEST = 6
#: Texts are worked through so many characters at a time; a longer text is taken whole.
CHUNK_CHARS = 3_000_000
_words = re.compile(WORD).findall


def counts_of(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs, at each of its places."""
    codes = pc.dictionary_encode(pa.array(keys)).indices.to_numpy()
    return np.bincount(codes)[codes]


def stretches(codes: np.ndarray, text: np.ndarray, exponent: int, shortest: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that may be in a run, and the number of the stretch of each.

    ``rounds`` only bounds the work on stretches that shrink slowly: what stays too long is still searched.
    """
    at, stretch, width = np.arange(len(codes)), text.astype(np.int64), int(codes.max(initial=0)) + 1
    for _ in range(rounds):
        keep = counts_of(stretch * width + codes[at]) >= exponent
        new, old = at[keep], stretch[keep]
        begins = np.ones(len(new), bool)
        begins[1:] = (np.diff(new) != 1) | (np.diff(old) != 0)
        number = np.cumsum(begins) - 1
        long_enough = (np.bincount(number) >= shortest)[number] if len(new) else keep[:0]
        done = len(new) == len(at) and long_enough.all()
        at, stretch = new[long_enough], number[long_enough]
        if done or not len(at):
            break
    return at, stretch


class Suffixes:
    """Suffix array, LCP and longest previous factors of a sequence in which every stretch ends in a mark of its own."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        order = np.argsort(s, kind="stable")
        sa, slots, rank = order.copy(), np.arange(n), np.zeros(n, np.int32)
        place, key, step, levels = order, s[order], 1, []
        while True:
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(first)
            rank = rank.copy()
            rank[place] = np.repeat(slots[start], np.diff(np.append(start, len(key))))
            levels.append(rank)
            tied = np.repeat(np.diff(np.append(start, len(key))) > 1, np.diff(np.append(start, len(key))))
            if not tied.any():
                break
            place, slots = place[tied], slots[tied]
            key = rank[place].astype(np.int64) * n + rank[place + step]  # what is tied ends before its mark
            order = np.argsort(key, kind="stable")
            place, key = place[order], key[order]
            sa[slots] = place
            step *= 2
        self.sa, self.levels = sa, levels

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b on are equal."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            more = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a, b, out = a + more, b + more, out + more
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words up to a and up to b, a before b, are equal."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << k) + 1, b - (1 << k) + 1
            more = ((x >= 0) & (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)])).astype(np.int64) << k
            a, b, out = a - more, b - more, out + more
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of the longest factor that also begins earlier, and where it begins (0 if none)."""
        n = len(self.sa)
        lcp = np.zeros(n + 1, np.int64)  # of neighbours r - 1 and r; nothing beyond the ends
        lcp[1:n] = self.forward(self.sa[:-1], self.sa[1:])
        best, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sa = np.append(self.sa, -1)  # the end on either side is smaller than all
        for side, shared in ((-1, lcp[:n]), (1, lcp[1:])):
            at, least = np.arange(n) + side, np.append(shared, 0)
            at[at < 0] = n
            at = np.append(at, n)
            open_ = np.flatnonzero(sa[at[:n]] > self.sa)
            while len(open_):
                via = at[open_]
                least[open_] = np.minimum(least[open_], least[via])
                at[open_] = at[via]
                open_ = open_[sa[at[open_]] > self.sa[open_]]
            better = least[:n] > best[self.sa]
            best[self.sa[better]], source[self.sa[better]] = least[:n][better], sa[at[:n]][better]
        return best, source


def blocks_of(factor: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks, each the longest previous factor at its start, or one new word; and the sequence's end."""
    following = (np.arange(len(factor)) + np.maximum(factor, 1)).tolist()
    at, starts, n = 0, [], len(factor)
    while at < n:
        starts.append(at)
        at = following[at]
    return np.array([*starts, n])


def border_runs(s: np.ndarray, suffixes: Suffixes, blocks: np.ndarray, exponent: int, shortest: int) -> np.ndarray:
    """Rows (start, end, period) of all runs that touch a border of a block, by Main's extensions from every border.

    A run of period q touches a border next to a block of at least (exponent - 1) / 2 periods, and half of the run is to
    the border's right or to its left; there, words at the border are equal to those q further.
    """
    most = 2 * np.diff(blocks) // (exponent - 1)
    most = np.maximum(np.append(most, 0), np.insert(most, 0, 0))
    border = np.repeat(blocks, most)
    period = np.arange(len(border)) - np.repeat(np.cumsum(most) - most, most) + 1
    found = []
    for right in (True, False):
        a = border if right else border - 1 - period
        b = border + period if right else border - 1
        fits = np.flatnonzero((a >= 0) & (b < len(s) - (not right)))  # the last word is a mark
        if exponent > 2:
            fits = fits[s[a[fits]] == s[b[fits]]]
        a, b, q, at = a[fits], b[fits], period[fits], border[fits]
        half = suffixes.forward(a, b) if right else suffixes.backward(a, b)
        long_enough = half >= np.maximum(exponent * q, shortest) / 2 - q
        a, b, q, at, half = (x[long_enough] for x in (a, b, q, at, half))
        if right:  # [at, at + q + half) and what is before
            start, end = at - suffixes.backward(a - 1, b - 1), at + q + half
        else:
            start, end = at - q - half, at + suffixes.forward(a + 1, b + 1)
        keep = end - start >= np.maximum(exponent * q, shortest)
        found.append(np.stack([start[keep], end[keep], q[keep]], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)  # of equal stretches the smallest period
    return rows[first]


def copied_runs(runs: list[tuple[int, int, int]], blocks: np.ndarray, factor: np.ndarray, source: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """All runs in order: those given (sorted), and their copies strictly inside later blocks."""
    if not runs:
        return runs
    known = set(runs)
    lengths = np.diff(blocks)
    for k in np.flatnonzero((lengths >= shortest + 2) & (factor[blocks[:-1]] > 0)).tolist():
        begin, end = int(blocks[k]), int(blocks[k + 1])
        origin = int(source[begin])
        shift, stop = begin - origin, origin + end - begin
        queue = [r for r in runs[bisect_right(runs, (origin, stop, stop)) : bisect_left(runs, (stop,))] if r[1] < stop]
        while queue:  # a block may overlap its source: copies are copied on
            i, j, q = heapq.heappop(queue)
            new = (i + shift, j + shift, q)
            if new not in known:
                known.add(new)
                insort(runs, new)
                if new[1] < stop:
                    heapq.heappush(queue, new)
    return runs


def runs_of(codes: np.ndarray, text: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period, of words given by number; no run leaves its text."""
    at, stretch = stretches(codes, text, exponent, shortest)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    marks = np.flatnonzero(np.append(np.diff(stretch) != 0, True)) + 1  # after each stretch's last word
    s = np.insert(codes[at].astype(np.int64), marks, int(codes.max()) + 1 + np.arange(len(marks)))
    where = np.insert(at, marks, -1)
    suffixes = Suffixes(s)
    factor, source = suffixes.previous_factors()
    blocks = blocks_of(factor)
    rows = list(map(tuple, border_runs(s, suffixes, blocks, exponent, shortest).tolist()))
    rows = np.array(copied_runs(rows, blocks, factor, source, shortest), np.int64).reshape(-1, 3)
    start = where[rows[:, 0]]
    rows = np.stack([start, start + rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def texts_of(batch: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of up to CHUNK_CHARS together (or one longer text), with the place of the first."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_CHARS)))
        yield at, pc.fill_null(batch.slice(at, stop - at), "").to_pylist()
        at = stop


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period) and collapsed.

    ``runs`` are all runs of at least ``exponent`` (2 or more) periods and ``shortest`` words, by start, then period.
    ``collapsed`` is the words joined by one blank, without those that a run contains after its first period. Null and
    empty texts have no words and no runs; repeated rows are worked through as often as they occur; null ids are kept; an
    empty table gives no rows; further columns are not read. No shuffle. A task holds CHUNK_CHARS of text at a time, or
    one longer text whole.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch.column(1)):
                words = [_words(t) for t in texts]
                sizes = np.array([len(w) for w in words])
                ends = np.cumsum(sizes)
                flat = [w for ws in words for w in ws]
                codes = pa.array(flat, pa.large_string()).dictionary_encode().indices.to_numpy()
                rows = runs_of(codes, np.repeat(np.arange(len(texts)), sizes), exponent, shortest)
                depth = np.zeros(len(flat) + 1, np.int64)
                np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
                np.add.at(depth, rows[:, 1], -1)
                gone = np.cumsum(depth[:-1]) > 0
                of = np.searchsorted(ends, rows[:, 0], side="right")
                collapsed = [" ".join(ws) for ws in words]
                for i in np.unique(of).tolist():
                    begin = int(ends[i]) - len(words[i])
                    collapsed[i] = " ".join([words[i][k] for k in np.flatnonzero(~gone[begin : ends[i]]).tolist()])
                first = rows[:, 0] - (ends - sizes)[of]
                fields = [pa.array(x, pa.int64()) for x in (first, rows[:, 1] - rows[:, 0], rows[:, 2])]
                offsets = np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), listed, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, every tenth of them (by the CRC-32 of its id) with a tail that repeats itself; null ids are left alone."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")

    words = F.array_remove(F.split(whole_text(text_col), r"[\x20\x09-\x0D]+"), "")
    # The words are bound once by the outer transform.
    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeat), F.lit(0))).otherwise(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the run with the greatest length in periods (start, length, period, exponent_milli), and digests.

    Ties go to the smaller start, then period; without a run the four are null. Edge cases are those of ``word_runs``.
    """
    found = word_runs(planted(docs, id_col, text_col))
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    best = F.aggregate("runs", none, lambda a, r: F.when(more(a, r), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return d.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
