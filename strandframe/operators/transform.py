"""Trimming of read pairs: UMI, quality tail, poly-G, mate overlap and adapters. Every trim keeps a prefix.

The UMI move is an expression. All trims of a pair run as one Arrow stage over batches, in which reads of similar length
form byte matrices: every rule is worked out for many reads at once, and the optimiser sees the kept lengths as plain
columns that it can filter without copying the rules. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.reads import tag_header, tag_plus

#: Fixed values of the overlap and adapter rules.
OVERLAP_LEAST, OVERLAP_COMPARED, OVERLAP_MISMATCHES, OVERLAP_SHARE = 31, 50, 5, 5
ADAPTER_LEAST, ADAPTER_SHARE = 4, 8
POLY_G_MISMATCHES = 5
#: Bytes of a matrix of reads, and comparisons done at once; these only bound memory.
MATRIX_BYTES, CELLS = 1 << 20, 1 << 22


@dataclass(frozen=True)
class Trim:
    """Options; a step without its option is left out."""

    tail_window: int | None = None
    tail_quality: int | None = None
    poly_g: int | None = None
    adapter1: str | None = None
    adapter2: str | None = None


def move_umi(pairs: DataFrame, length: int, skip: int = 0, mates: str = "both") -> DataFrame:
    """Moves the first bases of the chosen mates into both names; adds tag, umi_short and umi_ambiguous.

    Plus lines (p1, p2), if there are any, that repeat a name get the tag as well.
    """
    chosen = {"1": [1], "2": [2], "both": [1, 2]}[mates]
    umi = {k: F.substring(f"s{k}", 1, length) for k in chosen}
    tag = F.concat(F.lit(":"), F.concat_ws("_", *umi.values()))
    short = sum((F.length(f"s{k}") <= length + skip).cast("int") for k in chosen) > 0
    odd = sum(u.rlike("[^acgtACGT]").cast("int") for u in umi.values()) > 0
    cut = {f"{c}{k}": F.substring(F.col(f"{c}{k}"), F.lit(length + skip + 1), F.length(f"{c}{k}")) for k in chosen for c in "sq"}
    new = {"tag": tag, "umi_short": short, "umi_ambiguous": odd} | {f"h{k}": tag_header(F.col(f"h{k}"), tag) for k in (1, 2)}
    new |= {f"p{k}": tag_plus(F.col(f"p{k}"), F.col(f"h{k}"), tag) for k in (1, 2) if f"p{k}" in pairs.columns}
    return pairs.withColumns(new).withColumns(cut)


_COMPLEMENT = np.full(256, ord("N"), np.uint8)
for _a, _b in zip(b"ACGTacgt", b"TGCATGCA"):
    _COMPLEMENT[_a] = _b


class Reads:
    """Reads as rows of a byte matrix, filled up with zeros, and their lengths."""

    def __init__(self, at: np.ndarray, n: np.ndarray):
        self.at, self.n = at, n

    @staticmethod
    def of(texts: list[str | None]) -> Reads:
        raw = [(t or "").encode("latin-1", "replace") for t in texts]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(n.max(initial=0))
        joined = b"".join(r.ljust(width, b"\0") for r in raw)
        return Reads(np.frombuffer(joined, np.uint8).reshape(len(raw), width), n)

    def rows(self, chosen: np.ndarray) -> Reads:
        return Reads(self.at[chosen], self.n[chosen])

    def kept(self, n: np.ndarray) -> Reads:
        """Prefixes of the reads."""
        width = int(n.max(initial=0))
        at = self.at[:, :width]
        return Reads(np.where(np.arange(width) < n[:, None], at, 0).astype(np.uint8), n)

    def reversed(self) -> np.ndarray:
        """The matrix with every read turned round, still filled up at the end."""
        from_end = self.n[:, None] - 1 - np.arange(self.at.shape[1])
        return np.where(from_end >= 0, np.take_along_axis(self.at, np.maximum(from_end, 0), 1), 0).astype(np.uint8)

    def complement(self) -> Reads:
        back = self.reversed()
        return Reads(np.where(back > 0, _COMPLEMENT[back], 0).astype(np.uint8), self.n)


def groups_of(n: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers in groups of similar length, so that a group's matrix stays small."""
    order = np.argsort(n, kind="stable")
    end = len(order)
    while end > 0:  # from the longest on: a group's width is its last row's
        start = max(0, end - max(1, MATRIX_BYTES // max(1, int(n[order[end - 1]]))))
        yield order[start:end]
        end = start


def tail_kept(reads: Reads, quals: Reads, window: int, quality: int) -> np.ndarray:
    """Bases kept by a sliding window from the 3' end, without Ns at their end. The window over the first bases is not tried."""
    n, width = reads.n, reads.at.shape[1]
    ahead = np.cumsum(quals.at.astype(np.int64), axis=1)
    ahead = np.concatenate([np.zeros((len(n), 1), np.int64), ahead], axis=1)
    end = np.arange(window, max(width, window))  # last base of a window
    good = (ahead[:, end + 1] - ahead[:, end + 1 - window] >= window * (33 + quality)) & (end < n[:, None])
    last = np.where(good.any(1), window + good.shape[1] - 1 - good[:, ::-1].argmax(1), window - 1) if len(end) else np.full(len(n), window - 1)
    kept = np.where(n <= window, 0, np.where(last == n - 1, n, last - window + 2))
    solid = (reads.at != ord("N")) & (np.arange(width) < kept[:, None])
    return np.where(solid.any(1), width - solid[:, ::-1].argmax(1), 0) if width else kept


def poly_g_kept(reads: Reads, least: int) -> np.ndarray:
    """Bases kept when a 3' run of G with few other bases goes."""
    n, back = reads.n, reads.reversed()
    seen = np.arange(1, back.shape[1] + 1)
    other = np.cumsum(back != ord("G"), axis=1)
    stops = ((other > POLY_G_MISMATCHES) | ((other > seen // 8) & (seen >= least))) & (seen <= n[:, None])
    if not stops.shape[1]:
        return n.copy()
    scanned = np.where(stops.any(1), stops.argmax(1), n)
    looked = np.minimum(scanned + 1, n)
    g = (back == ord("G")) & (seen <= looked[:, None])
    first = np.where(g.any(1), n - (back.shape[1] - g[:, ::-1].argmax(1)), n)
    return np.where(scanned >= least, first, n)


def _first_good(text: Reads, pattern: np.ndarray, first: int, ends: np.ndarray, least) -> np.ndarray:
    """For each row the first place from ``first`` to before ``ends`` at which enough of the pattern agrees, or ``first`` - 1.

    ``pattern`` is one row or one for each read; ``least(places, rows)`` says how many bases must agree.
    """
    width, rows = pattern.shape[-1], np.arange(len(ends))
    found = np.full(len(ends), first - 1)
    start, stop = first, int(ends.max(initial=first))
    wide = np.zeros((len(ends), text.at.shape[1] - min(first, 0) + width), np.uint8)
    wide[:, -min(first, 0) : -min(first, 0) + text.at.shape[1]] = text.at
    while start < stop and len(rows):
        places = np.arange(start, min(stop, start + max(1, CELLS // max(1, width * len(rows)))))
        agree = np.zeros((len(rows), len(places)), np.int16)
        for k in range(width):
            column = pattern[rows, k][:, None] if pattern.ndim == 2 else pattern[k]
            at = places[0] + k - min(first, 0)
            agree += (wide[rows, at : at + len(places)] == column) & (column != 0)
        good = (agree >= least(places, rows)) & (places < ends[rows, None])
        hit = good.any(1)
        found[rows[hit]] = places[good[hit].argmax(1)]
        rows = rows[~hit]
        start += len(places)
        rows = rows[ends[rows] > start]
    return found


def _shifts(text: Reads, other: Reads) -> np.ndarray:
    """First shift of each other read along its text whose common part agrees well enough, or -1."""

    def least(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
        common = np.minimum(text.n[rows, None] - places, other.n[rows, None])
        return np.minimum(common, OVERLAP_COMPARED) - np.minimum(OVERLAP_MISMATCHES, common // OVERLAP_SHARE)

    return _first_good(text, other.at[:, :OVERLAP_COMPARED], 0, text.n - OVERLAP_LEAST + 1, least)


def find_overlaps(first: Reads, second: Reads) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) of each first mate's overlap with the second's reverse complement; a negative offset reaches past
    its start, a negative length stands for no overlap."""
    back = second.complement()
    ahead = _shifts(first, back)
    offset, length = ahead, np.minimum(first.n - ahead, back.n)
    rest = np.flatnonzero(ahead < 0)
    behind = _shifts(back.rows(rest), first.rows(rest))
    offset[rest] = -behind
    length[rest] = np.where(behind >= 0, np.minimum(back.n[rest] - behind, first.n[rest]), -1)
    return offset, length


def _gapped(longer: np.ndarray, other: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Longest prefix of ``other`` that matches ``longer`` with one base of ``longer`` left out; 0 if none is good enough."""
    width = min(other.shape[1], longer.shape[1] - 1)
    if width < 2:
        return np.zeros(len(longest), np.int64)
    straight = np.cumsum(longer[:, :width] != other[:, :width], axis=1)
    shifted = np.cumsum(longer[:, 1 : width + 1] != other[:, :width], axis=1)
    best = np.minimum.accumulate(straight - shifted, axis=1)[:, :-1] + shifted[:, 1:]  # the gap lies before the last base
    size = np.arange(2, width + 1)
    good = (size >= ADAPTER_SHARE) & (best <= size // ADAPTER_SHARE - 1) & (size <= longest[:, None])
    return np.where(good.any(1), width - good[:, ::-1].argmax(1), 0)


def adapter_starts(reads: Reads, adapter: str) -> np.ndarray:
    """Where the adapter begins in each read (negative: before it); NONE where it is not found."""
    a = np.frombuffer(adapter.encode("ascii"), np.uint8)
    n, m = reads.n, len(a)
    first = -4 if m >= 16 else -3 if m >= 12 else -2 if m >= 8 else 0

    def least(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
        compared = np.minimum(n[rows, None] - places, m)
        return compared - np.maximum(-places, 0) - compared // ADAPTER_SHARE

    start = _first_good(reads, a, first, n - ADAPTER_LEAST, least)
    found = np.where(start >= first, start, NONE)
    head = np.zeros((len(n), m + 2), np.uint8)  # a gap is searched from the read's start
    head[:, : reads.at.shape[1]] = reads.at[:, : m + 2]
    pattern = np.broadcast_to(a, (len(n), m))
    for longer, other, longest, enough in ((head, pattern, np.minimum(n - 1, m), n > ADAPTER_LEAST + 1), (pattern, head, np.minimum(n, m - 1), n > ADAPTER_LEAST)):
        size = _gapped(longer, other, longest)
        place = np.where(size == longest, 0, (n - 1 if other is pattern else n) - size)
        found = np.where((found == NONE) & enough & (size > 0), place, found)
    return found


#: Stands for an adapter that is not found; no place is as small.
NONE = -1000


def trim_reads(seqs: tuple[Reads, Reads], quals: tuple[Reads, Reads], o: Trim) -> dict[str, np.ndarray]:
    """The columns of ``trim_pairs`` for one group of pairs; a negative ov_length stands for no overlap."""
    n = [s.n for s in seqs]
    out: dict[str, np.ndarray] = {}
    tail = [tail_kept(s, q, o.tail_window, o.tail_quality) if o.tail_window else s.n for s, q in zip(seqs, quals)]
    go = (tail[0] > 0) & (tail[1] > 0) if o.tail_window else np.ones(len(n[0]), bool)
    poly = [np.where(go, poly_g_kept(s.kept(t), o.poly_g), t) if o.poly_g else t for s, t in zip(seqs, tail)]
    offset, length = np.zeros(len(go), np.int64), np.full(len(go), -1)
    adapters = (o.adapter1, o.adapter2)
    reads = [s.kept(p) for s, p in zip(seqs, poly)]
    if o.adapter1:
        rows = np.flatnonzero(go)
        offset[rows], length[rows] = find_overlaps(reads[0].rows(rows), reads[1].rows(rows))
    inside = (length >= 0) & (offset < 0)
    for k in (0, 1):
        start = np.full(len(go), NONE)
        if adapters[k]:
            rows = np.flatnonzero(go & ~inside)
            start[rows] = adapter_starts(reads[k].rows(rows), adapters[k])
        at = start != NONE
        kept = np.where(inside, np.minimum(poly[k], length), np.where(at, np.maximum(start, 0), poly[k]))
        gone = poly[k] - kept
        matched = np.where(at & (start < 0), len(adapters[k] or "") + start, gone)
        values = {"kept": kept, "tail": n[k] - tail[k], "polyg": tail[k] - poly[k], "cut": inside | at, "overlap": np.where(inside, gone, 0), "adapter": np.where(inside, 0, gone), "cutbases": np.where(inside, gone, np.where(at, matched, 0))}
        out |= {f"{c}{k + 1}": v for c, v in values.items()}
    return out | {"ov_offset": offset, "ov_length": length}


def by_groups(columns: list[list[str | None]], work) -> dict[str, np.ndarray]:
    """Runs ``work`` on groups of rows of similar length, given as Reads, and puts the results in the rows' order."""
    sizes = np.array([max((len(t or "") for t in row), default=0) for row in zip(*columns)], np.int64)
    out: dict[str, np.ndarray] = {}
    for rows in groups_of(sizes):
        for name, values in work(*(Reads.of([c[i] for i in rows.tolist()]) for c in columns)).items():
            out.setdefault(name, np.zeros(len(sizes), values.dtype))[rows] = values
    return out


@F.pandas_udf(T.StructType([T.StructField("ov_offset", T.IntegerType()), T.StructField("ov_length", T.IntegerType())]))
def mate_overlap(first: pd.Series, second: pd.Series) -> pd.DataFrame:
    found = by_groups([list(first), list(second)], lambda a, b: dict(zip(("ov_offset", "ov_length"), find_overlaps(a, b))))
    frame = pd.DataFrame(found, columns=["ov_offset", "ov_length"], dtype="Int64")
    return frame.mask(frame["ov_length"] < 0)


def adapter_places(adapter: str):
    """A function of a read's column: where the adapter begins, or null."""

    @F.pandas_udf(T.IntegerType())
    def places(read: pd.Series) -> pd.Series:
        found = pd.Series(by_groups([list(read)], lambda r: {"at": adapter_starts(r, adapter)}).get("at", []), dtype="Int64")
        return found.mask(found == NONE)

    return places


COUNTED = ["kept", "tail", "polyg", "cut", "overlap", "adapter", "cutbases"]


def trim_pairs(pairs: DataFrame, o: Trim) -> DataFrame:
    """Adds kept1, kept2 (prefix lengths), removed bases of each step and mate, the overlap, cut flags and adapter bases.

    If the quality tail leaves either mate empty, the later steps do nothing. Mates are compared, and cut where they
    overlap, only if adapters are given. Null mates count as empty. Columns of the results' names are replaced.
    """
    made = [f"{c}{k}" for k in (1, 2) for c in COUNTED] + ["ov_offset", "ov_length"]
    pairs = pairs.drop(*made)
    if not (o.tail_window or o.poly_g or o.adapter1):
        size = {f"kept{k}": F.coalesce(F.length(f"s{k}"), F.lit(0)) for k in (1, 2)}
        none = {c: F.lit(False) if c[:3] == "cut" and len(c) == 4 else F.lit(None).cast("int") if c[:2] == "ov" else F.lit(0) for c in made if c not in size}
        return pairs.withColumns(size | none)
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(c).to_pylist() for c in ("s1", "s2", "q1", "q2")]
            found = by_groups(texts, lambda a, b, p, q: trim_reads((a, b), (p, q), o))
            lost = found["ov_length"] < 0 if found else np.zeros(0, bool)
            columns = []
            for c in made:
                values = found.get(c, np.zeros(0, np.int64))
                kind = pa.bool_() if c[:3] == "cut" and len(c) == 4 else pa.int32()
                columns.append(pa.array(values, kind, mask=lost if c[:2] == "ov" else None))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *made])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in pairs.schema] + [T.StructField(c, T.BooleanType() if c[:3] == "cut" and len(c) == 4 else T.IntegerType()) for c in made])
    return pairs.mapInArrow(run, schema)


def cut(pairs: DataFrame) -> DataFrame:
    """Sequences and qualities shortened to their kept prefixes."""
    return pairs.withColumns({f"{c}{k}": F.substring(F.col(f"{c}{k}"), F.lit(1), F.col(f"kept{k}")) for k in (1, 2) for c in "sq"})
