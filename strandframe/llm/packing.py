"""Packing of token sequences by column generation for the cutting-stock problem.

1. One pass over the texts counts tokens and cuts every document into pieces: full ones of the sequence length and one
   tail. Full pieces need no plan.
2. Tails are counted by length class: a histogram of fixed size, however many documents there are. Tails of up to EXACT
   tokens are classes of their own length; of each such class as many as fit BUNDLE tokens are planned as one item, so
   that rounding costs a bundle and not each short document. All items are multiples of ``grain``, rounded up. On these
   the driver solves the cutting-stock linear program; columns (patterns of classes that
   fit one sequence) are priced by a knapsack dynamic program. Patterns are used a whole number of times (rounded
   down); the bounded rest is packed first-fit by decreasing class.
3. Each tail gets its rank within its class from counts by (class, bucket) and a row number in the bucket, so a class
   that holds a third of all documents is still ranked by many tasks. Its rank names its sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .base import materialise, tokenizer_path
from .merges import MergeTable, spread

SEQUENCE = 4096
#: Length classes are multiples of this; smaller leaves less padding and gives the linear program more rows.
GRAIN = 16
#: Shorter pieces are counted by exact length, and planned as bundles of at most so many tokens.
EXACT, BUNDLE = 256, 1024
END_ID = 2
#: Fixed value of the vocabulary's format: its pre-tokenising pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CACHE_WORDS = 300_000
CHUNK_CHARS = 1_500_000
CACHED_WORD_CHARS = 256


class WordEncoder(MergeTable):
    """Ids of whole texts, each distinct blank-separated word once.

    For a tokenizer that drops white space and never joins across it, the ids of a text are those of its words in turn.
    Distinct words in Latin-1 are split, lower-cased and merged many at once; all others, and whole texts that hold a
    special token's string, go through the tokenizers library.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache: dict[str, bytes] = {"": b""}
        self.pieces = regex.compile(r"\n|" + PIECES).findall

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Unsigned 32-bit ids of each text; memory is bounded by CHUNK_CHARS and the longest text."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_CHARS)))
            yield from self._encode(pc.fill_null(texts.slice(at, stop - at), ""))
            at = stop

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold neither blanks nor line breaks. A word of letters only is one piece."""
        plain, out = range(len(words)), [b""] * len(words)
        try:
            "".join(words).encode("latin-1")
        except UnicodeEncodeError:
            plain = [i for i, word in enumerate(words) if word.isascii() or max(word) <= "\xff"]
            for i in set(range(len(words))).difference(plain):
                out[i] = np.array(self.library.encode(words[i], add_special_tokens=False).ids, "<u4").tobytes()
        whole = [i for i in plain if words[i].isalpha()]
        cut = [i for i in plain if not words[i].isalpha()]
        lowered = [words[i].lower() for i in whole]
        found = self.pieces("\n".join([words[i] for i in cut]).lower())
        distinct = list(set(lowered).union(found).difference("\n"))
        ids = dict(zip(distinct, self.exact_many([x.encode() for x in distinct])))
        for i, word in zip(whole, lowered):
            out[i] = ids[word]
        at, part = 0, []
        for piece in found:
            if piece == "\n":
                out[cut[at]] = b"".join(part)
                at, part = at + 1, []
            else:
                part.append(ids[piece])
        if cut:
            out[cut[at]] = b"".join(part)
        return out

    def _encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        marked = np.zeros(len(texts), bool)
        for token in self.special:
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.cache) > CACHE_WORDS:
            self.cache = {"": b""}
        found = list(map(self.cache.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self.encode_words([distinct[i] for i in missing])):
            found[i] = ids
            if len(distinct[i]) <= CACHED_WORD_CHARS:
                self.cache[distinct[i]] = ids
        ids, ends = spread(found, coded.indices.to_numpy())
        ends = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(words).to_numpy())]
        for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if marked[i]:
                yield np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            else:
                yield ids[a:b]


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, sequence: int, end_id: int) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens. Narrow; ids themselves are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            of, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(word_encoder(path).encode_batch(batch.column(1))):
                ids = ids.tobytes() + end
                n = len(ids) // 4
                for at in range(0, n, sequence):
                    piece = ids[4 * at : 4 * (at + sequence)]
                    of.append(i)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            doc_id = batch.column(0).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([doc_id, *longs], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        word_encoder(path).cache = {"": b""}  # the worker goes on to other stages

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value of a sequence and how often it holds each class."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        worth = np.where(fits, best[np.maximum(room - sizes, 0)] + values, -1.0)
        k = int(worth.argmax())
        best[room], choice[room] = (worth[k], k) if worth[k] > best[room - 1] + 1e-12 else (best[room - 1], -1)
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """The cutting-stock linear program: patterns (rows) and how often each is used (fractional) to meet the demand.

    Revised simplex on the basis of patterns, which starts with one class in each and takes the column that the
    knapsack prices best until none saves more than a millionth of a sequence. A round limit stops it earlier with a
    feasible, only less tight, plan.
    """
    basis = np.diag(capacity // sizes).astype(float)  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand.astype(float)
    for step in range(rounds):
        value, column = price(inverse.sum(0), sizes, capacity)
        if value <= 1 + 1e-6:
            break
        enter = inverse @ column
        able = np.flatnonzero(enter > 1e-9)
        leave = able[np.argmin(use[able] / enter[able])]
        amount = use[leave] / enter[leave]
        use -= amount * enter
        use[leave] = amount
        row = inverse[leave] / enter[leave]
        inverse -= np.outer(enter, row)
        inverse[leave] = row
        basis[:, leave] = column
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
            use = inverse @ demand
    return basis.T.astype(np.int64), np.maximum(use, 0)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole-numbered patterns that hold every counted item exactly once: (items of each class 1..capacity, times)."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    plan: list[tuple[np.ndarray, int]] = []

    def add(counts: np.ndarray, times: int) -> None:
        full = np.zeros(capacity + 1, np.int64)
        full[sizes] = counts
        plan.append((full, times))

    patterns, use = column_generation(sizes, left, capacity)
    for pattern, times in sorted(zip(patterns, use), key=lambda x: -x[1]):
        with np.errstate(divide="ignore"):
            times = int(min(np.floor(times + 1e-9), (left[pattern > 0] // pattern[pattern > 0]).min()))
        if times > 0:
            left -= pattern * times
            add(pattern, times)
    # The rest is bounded by the number of patterns times what one holds. Fill by decreasing class.
    while left.any():
        counts, room = np.zeros(len(sizes), np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            counts[k] = min(left[k], room // sizes[k])
            room -= counts[k] * sizes[k]
        times = int((left[counts > 0] // counts[counts > 0]).min())
        left -= counts * times
        add(counts, times)
    return plan


class Slots:
    """For each class, which sequence and place the item of a given rank takes."""

    def __init__(self, plan: list[tuple[np.ndarray, int]], capacity: int):
        base = np.cumsum([0] + [times for _, times in plan])
        self.sequences = int(base[-1])
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for c in range(1, capacity + 1):
            users = [(counts[c], times, base[p]) for p, (counts, times) in enumerate(plan) if counts[c]]
            if users:
                each, times, first = (np.array(x, np.int64) for x in zip(*users))
                self.of[c] = (np.concatenate([[0], np.cumsum(each * times)]), each, first)

    def take(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, place = np.zeros(len(classes), np.int64), np.zeros(len(classes), np.int64)
        for c in np.unique(classes).tolist():
            mine = classes == c
            ends, each, first = self.of[c]
            r = ranks[mine]
            p = np.searchsorted(ends, r, side="right") - 1
            copy, item = np.divmod(r - ends[p], each[p])
            sequence[mine], place[mine] = first[p] + copy, -c * (1 << 20) + item
        return sequence, place


class Bundles:
    """Items of short pieces: of each exact length, full bundles and one with what is left, each taking the next rank of its class."""

    def __init__(self, histogram: dict[int, int], capacity: int, grain: int):
        self.demand = {size: n for size, n in histogram.items() if size > 0}
        self.of: dict[int, tuple[int, int, int, int, int, int]] = {}
        for length, n in sorted((-size, n) for size, n in histogram.items() if size < 0):
            each = max(1, min(BUNDLE, capacity * grain) // length)
            full, rest = divmod(n, each)
            place = []
            for count, bundles in ((each, full), (rest, int(rest > 0))):
                size = -(-count * length // grain)
                place += [size, self.demand.get(size, 0)]
                if bundles:
                    self.demand[size] = self.demand.get(size, 0) + bundles
            self.of[-length] = (each, full, *place)

    def items(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece its item's class and rank, and its place within the item."""
        size, rank, place = classes.astype(np.int64), ranks.astype(np.int64), np.zeros(len(classes), np.int64)
        for c in np.unique(classes[classes < 0]).tolist():
            each, full, size_full, at_full, size_rest, at_rest = self.of[c]
            mine = np.flatnonzero(classes == c)
            bundle, place[mine] = np.divmod(ranks[mine], each)
            whole = bundle < full
            size[mine] = np.where(whole, size_full, size_rest)
            rank[mine] = np.where(whole, at_full + bundle, at_rest)
        return size, rank, place


def pack(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    grain: int = GRAIN,
    end_id: int = END_ID,
) -> DataFrame:
    """Pack all texts, each followed by ``end_id``, into sequences of at most ``sequence`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are one
    token (the end id). Repeated rows are packed as often as they occur; null ids are kept; an empty table gives no
    rows; further columns are not read. Texts of any length are cut at multiples of ``sequence``.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    capacity, buckets = sequence // grain, 1024
    rank_order = ["doc_id", "start", "ids_crc32"]
    pieces = materialise(
        cut_pieces(docs, path, id_col, text_col, sequence, end_id)
        .withColumn("size", F.when(F.col("length") <= min(EXACT, capacity * grain), -F.col("length")).otherwise(F.ceil(F.col("length") / grain)).cast("int"))
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(buckets)).cast("int"))
    )
    counts = pieces.groupBy("size", "bucket").agg(F.count("*").alias("n"))  # at most classes x buckets rows
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    bundles = Bundles(histogram, capacity, grain)
    slots = Slots(plan_patterns(bundles.demand, capacity) if histogram else [], capacity)

    ranked = pieces.join(counts.select("size", "bucket", "ahead"), ["size", "bucket"]).withColumn(
        "rank", F.col("ahead") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy(*rank_order)) - 1
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank, inner = bundles.items(batch.column("size").to_numpy(), batch.column("rank").to_numpy())
            seq, place = slots.take(size, rank)
            place = place * (1 << 12) + inner
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(seq), pa.array(place)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
    within = Window.partitionBy("sequence_id").orderBy("place", *rank_order)  # at most sequence / 1 pieces
    return (
        ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "rank")
        .mapInArrow(assign, schema)
        .withColumn("offset", F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("place")
    )
