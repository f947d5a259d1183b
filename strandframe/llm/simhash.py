"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints that differ in at most three bits agree in whole blocks of bits, so each distinct fingerprint is dealt to
one bucket for every choice of such blocks. Within a bucket the 64 bit planes are stored vertically (one 64-bit word
holds one bit of 64 candidates); a fingerprint is compared with 64 candidates at once by adding planes, three at a
time, into bitwise carry-save counters. Words whose candidates have all passed the radius are abandoned.

The pipeline's stage links documents by the Jaccard similarity of their shingle sets, of which close fingerprints are
only a sign. Documents with close fingerprints are verified first. Then all others meet by the rarest shingles of each
(prefix, length and positional filters, none of which loses a pair), and these candidates are verified too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .base import materialise, stored
from .components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Rows of a bucket above which it is cut into groups that are compared pairwise by different tasks.
BUCKET_ROWS = 4096
#: Rows and (row, word) items handled at once; these only bound memory.
CHUNK_ROWS = 1 << 16
CHUNK_ITEMS = 1 << 15
CHUNK_HASHES = 1 << 18
#: The pipeline's stage: least similarity of shingle sets, and buckets of the table that orders shingles by rarity.
THRESHOLD = 0.8
RARITY_BUCKETS = 1 << 16
#: Rows of one shingle that one task may count and deal.
GROUP_ROWS = 1 << 18
#: Bits of the parity bitmap by which candidates are sifted before their shingles are compared.
BITMAP = 1024
#: Ids up to which a set of documents is broadcast.
BROADCAST_ROWS = 1 << 17


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def shingle_hashes(text: str | bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each word shingle with repeats; a text of fewer words is one shingle, a text without words has none."""
    words = (text if isinstance(text, bytes) else as_bytes(text)).lower().split()
    if len(words) > shingle:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    else:
        joined, n = iter([b" ".join(words)] if words else []), int(bool(words))
    return np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)


def fingerprint_many(texts: Iterator[str | None], shingle: int = SHINGLE) -> Iterator[int]:
    """Unsigned SimHash of each text, over its word shingles with repeats."""
    hashes: list[np.ndarray] = []
    held = 0

    def flush() -> Iterator[int]:
        counts = np.array([len(h) for h in hashes], np.int64)
        full = np.flatnonzero(counts)
        out = np.zeros(len(hashes), np.uint64)
        if len(full):
            bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = (np.cumsum(counts) - counts)[full]
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            majority = (2 * ones > counts[full, None]).astype(np.uint8)
            out[full] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
        return iter(out.tolist())

    for text in texts:
        hashes.append(shingle_hashes(text, shingle))
        held += len(hashes[-1])
        if held >= CHUNK_HASHES:
            yield from flush()
            hashes, held = [], 0
    yield from flush()


def with_fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """The kept columns and ``fp`` (the fingerprint as a signed long). One narrow stage."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter(fingerprint_many(iter(batch.column("_text").to_pylist()), shingle), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "fp long"])
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of every choice of ``blocks - radius`` out of ``blocks`` runs of bits: a near pair agrees under one at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(runs, blocks - radius)]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n rows through the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def near_pairs(fp: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i > j) of the same run (equal, adjacent run numbers) whose fingerprints differ in at most radius bits."""
    starts = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
    sizes = np.diff(np.append(starts, len(run)))
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    of_run = np.repeat(np.arange(len(starts)), sizes)
    slot = first_word[of_run] * 64 + np.arange(len(run)) - starts[of_run]  # a run begins at a new word
    total = int(words.sum())
    laid = np.zeros(total * 64, np.uint64)
    laid[slot] = fp
    filled = np.zeros(total * 64, np.uint8)
    filled[slot] = 1
    valid = np.packbits(filled, bitorder="little").view("<u8")
    row_at = np.full(total * 64, -1, np.int64)
    row_at[slot] = np.arange(len(fp))
    planes = np.stack([np.packbits(((laid >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for b in range(64)])
    multi = np.flatnonzero(sizes[of_run] > 1)
    each = np.minimum(slot[multi] // 64 - first_word[of_run[multi]] + 1, words[of_run[multi]])  # words up to the row's own
    ends = np.cumsum(each)
    width = int(radius).bit_length()
    ahead = (1 << width) - 1 - radius  # counters start here, so that they overflow beyond the radius
    at = 0
    while at < len(multi):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_ITEMS)))
        rows = np.repeat(multi[at:stop], each[at:stop])
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(each[at:stop]) - each[at:stop], each[at:stop])
        word = first_word[of_run[rows]] + offset
        at = stop
        count = [np.full(len(rows), np.uint64(0) - np.uint64(ahead >> k & 1)) for k in range(width)]
        over = ~valid[word]

        def plane(b: int) -> np.ndarray:
            return planes[b][word] ^ (np.uint64(0) - ((fp[rows] >> np.uint64(b)) & np.uint64(1)))

        def add(x: np.ndarray, k: int) -> None:
            nonlocal over
            for j in range(k, width):
                count[j], x = count[j] ^ x, count[j] & x
            over = over | x

        for b in range(0, 63, 3):
            x, y, z = plane(b), plane(b + 1), plane(b + 2)
            half = x ^ y
            add(half ^ z, 0)
            add((x & y) | (half & z), 1)
            if b % 12 == 9:
                live = np.flatnonzero(~over)
                if len(live) < 0.7 * len(rows):
                    rows, word, over, count = rows[live], word[live], over[live], [c[live] for c in count]
        add(plane(63), 0)
        live = np.flatnonzero(~over)
        hit = np.unpackbits((~over[live]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        item, bit = np.nonzero(hit)
        i, j = rows[live][item], row_at[word[live][item] * 64 + bit]
        yield i[j < i], j[j < i]


def dealt_cells(keyed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of the buckets (equal keys) with two rows or more, partitioned by bucket and cell (i, j).

    Large buckets are cut into groups by the hash of the value; each pair of groups is one cell.
    """
    groups = keyed.groupBy(*keys).count().where(F.col("count") > 1).select(*keys, F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("g"))
    return in_cells(keyed.join(groups, keys), F.col("g"), value).select(*keyed.columns, "i", "j").repartition(*keys, "i", "j")


def in_cells(rows: DataFrame, groups: Column, value: str) -> DataFrame:
    """Each row once for every cell (i, j) of its group, by the hash of its value; every two rows of a bucket meet in a cell."""
    mine = rows.withColumn("g_", groups).withColumn("s_", F.pmod(F.xxhash64(value), F.col("g_")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("g_") - 1), lambda j: F.struct(F.least(j, F.col("s_")).alias("i"), F.greatest(j, F.col("s_")).alias("j")))
    return mine.select(*rows.columns, F.explode(cells).alias("c_")).select(*rows.columns, "c_.i", "c_.j")


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within the radius of each other, directly or in steps.

    From each bucket only a spanning forest is returned (as many links as rows at most), not every pair. More blocks
    are used for more fingerprints, to keep buckets short; every number of blocks finds all pairs.
    """
    n = fps.count()
    blocks = radius + (1 if n <= 1 << 20 else 2 if n <= 1 << 28 else 3)
    masks = block_masks(blocks, radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)))).alias("x")).select("x.t", "x.k", "fp")
    dealt = dealt_cells(keyed, ["t", "k"], "fp").select("t", "k", "i", "j", "fp").sortWithinPartitions("t", "k", "i", "j", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            cell, fp = rows[:, :4], rows[:, 4].astype(np.int64).view(np.uint64)
            run = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)]))
            root = np.arange(len(fp))
            for i, j in near_pairs(fp, run, radius):
                root = local_roots(len(fp), np.concatenate([np.arange(len(fp)), i]), np.concatenate([root, j]))
            linked = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(rows[root[linked], 4]), pa.array(rows[linked, 4])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= CHUNK_ROWS:
                rows = np.concatenate(held)
                last = int(np.flatnonzero((rows[:, :4] == rows[-1, :4]).all(1))[0])  # the last cell may go on
                held = [rows[last:]]
                if last:
                    yield flush(rows[:last])
        if rest := sum(map(len, held)):
            assert rest
            yield flush(np.concatenate(held))

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Every document's fingerprint and near-duplicate component: doc_id, fingerprint (16 hex digits), component_id.

    The component id is the smallest id reachable through fingerprints within the radius. Null and empty texts have
    fingerprint zero and are linked like any other. Repeated rows are returned as often as they occur. A null id takes
    part but is never the smallest unless its component has no other. An empty table gives no rows. Further columns are
    not read.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialise(with_fingerprint(ids, "text", ["doc_id"], shingle))
    least = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(least.select("fp"), radius))
    rooted = least.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(of_root, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row as one struct ``doc`` beside id_, text_ and __row (a hash of both), so that columns may have any names."""
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    return docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), row.alias("__row"))


def unpacked(kept: DataFrame, names: list[str]) -> DataFrame:
    """The columns of the rows that stay, one for each __row."""
    return kept.dropDuplicates(["__row"]).select(*(F.col("doc").getField(c).alias(c) for c in names))


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: shingles take many times the memory of their text."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def parity(h: np.ndarray) -> np.ndarray:
    """Bitmap of a set of hashes: sets whose bitmaps differ in d bits differ in d elements at least."""
    at = ((h >> np.uint64(32)) % np.uint64(BITMAP)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITMAP) & 1).astype(np.uint8)).view(np.int64)


def with_sets(docs: DataFrame, text_col: str, id_col: str, shingle: int) -> DataFrame:
    """One row per document: its id, __row, fp, sk (identity of its shingle set; 0 where it is empty), n (the set's size)
    and bits (the set's parity bitmap).

    Rows with null ``sk`` hold in n how many documents of a task have a shingle of bucket __row of the rarity table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY_BUCKETS, np.int64)
        kind = None
        for batch in in_slices(batches):
            kind = batch.schema.field(id_col).type
            texts = batch.column("_text").to_pylist()
            fp = np.fromiter(fingerprint_many(iter(texts), shingle), np.uint64, len(texts))
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            sk = np.array([xxh64_intdigest(h.tobytes(), SEED) if len(h) else 0 for h in sets], np.uint64)
            if sets:
                counts += np.bincount((np.concatenate(sets) % np.uint64(RARITY_BUCKETS)).astype(np.int64), minlength=RARITY_BUCKETS)
            n = pa.array([len(h) for h in sets], pa.int64())
            bits = pa.array([parity(h) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("__row"), pa.array(fp.view(np.int64)), pa.array(sk.view(np.int64)), n, bits], names)
        full = np.flatnonzero(counts)
        if len(full):
            none = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), kind), pa.array(full), none, none, pa.array(counts[full]), pa.nulls(len(full), pa.list_(pa.int64()))], names)

    names = [id_col, "__row", "fp", "sk", "n", "bits"]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, __row long, fp long, sk long, n long, bits array<long>"
    return docs.select(id_col, "__row", F.col(text_col).alias("_text")).mapInArrow(run, schema)


def with_prefix(sets: DataFrame, shingle: int, per_mille: int, rarity: np.ndarray, busy: bool) -> DataFrame:
    """One row per prefix shingle of (sk, comp, _text): tok, p (its place in the order), sk, comp, n.

    Either those of buckets of the rarity table with more than GROUP_ROWS documents, or all others.
    """
    most = GROUP_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            toks, sizes = [], []
            for text in batch.column("_text").to_pylist():
                h = np.unique(shingle_hashes(text, shingle))
                h = h[np.lexsort((h, rarity[(h % np.uint64(RARITY_BUCKETS)).astype(np.int64)]))]
                toks.append(h[: len(h) - -(-len(h) * per_mille // 1000) + 1])
                sizes.append(len(h))
            if not toks:
                continue
            held = np.array([len(t) for t in toks])
            p = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            own = [np.repeat(batch.column(c).to_numpy(), held) for c in ("sk", "comp")]
            tok = np.concatenate(toks)
            used = (rarity[(tok % np.uint64(RARITY_BUCKETS)).astype(np.int64)] > most) == busy
            yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (tok.view(np.int64), p, *own, np.repeat(np.array(sizes, np.int64), held))], ["tok", "p", "sk", "comp", "n"])

    return sets.mapInArrow(run, "tok long, p long, sk long, comp long, n long")


def met_pairs(run: np.ndarray, n: np.ndarray, p: np.ndarray, comp: np.ndarray, per_mille: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the same run (sorted by n within it) that pass the length and the positional filter and are not yet linked."""
    i, step = np.arange(len(run)), 0
    while True:
        step += 1
        i = i[i + step < len(run)]
        j = i + step
        i = i[(run[j] == run[i]) & (n[j] * per_mille <= n[i] * 1000)]
        if not len(i):
            return
        j = i + step
        reach = np.minimum(p[i], p[j]) + np.minimum(n[i] - p[i], n[j] - p[j])
        ok = (comp[i] != comp[j]) & (reach * (1000 + per_mille) >= (n[i] + n[j]) * per_mille)
        yield i[ok], j[ok]


def prefix_pairs(sets: DataFrame, shingle: int, per_mille: int, rarity: np.ndarray) -> DataFrame:
    """Pairs (x, y) of sets that share a prefix shingle and are in different components so far: all that can be similar.

    Shingles that the rarity table shows to be in at most GROUP_ROWS documents are counted where one shuffle brings them
    together. Any others, which one task couldn't hold, are counted first, by an aggregation, and dealt by these counts;
    they are written once, after a second pass over the texts.
    """
    names = ["tok", "i", "j", "n", "sk", "p", "comp"]
    few = with_prefix(sets, shingle, per_mille, rarity, busy=False).withColumn("comp", F.when(F.col("comp") != F.col("sk"), F.col("comp")))
    few = few.withColumn("count", F.count("*").over(Window.partitionBy("tok"))).where("count > 1").withColumn("comp", F.coalesce("comp", "sk"))
    dealt = [in_cells(few, F.ceil(F.col("count") / BUCKET_ROWS).cast("int"), "sk").repartition("tok", "i", "j")]
    if rarity.max() > GROUP_ROWS:
        dealt.append(dealt_cells(stored(with_prefix(sets, shingle, per_mille, rarity, busy=True)), ["tok"], "sk"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cell, n, sk, p, comp = rows[:, :3], *rows[:, 3:].T
            run = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)]))
            x, y, size = [], [], 0
            for i, j in met_pairs(run, n, p, comp, per_mille):
                x.append(np.minimum(sk[i], sk[j]))
                y.append(np.maximum(sk[i], sk[j]))
                size += len(i)
                if size >= CHUNK_HASHES:
                    both = np.unique(np.stack([np.concatenate(x), np.concatenate(y)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["x", "y"])
                    x, y, size = [], [], 0
            if size:
                both = np.unique(np.stack([np.concatenate(x), np.concatenate(y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["x", "y"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int64))
            if sum(map(len, held)) >= CHUNK_ROWS:
                rows = np.concatenate(held)
                last = int(np.flatnonzero((rows[:, :3] == rows[-1, :3]).all(1))[0])  # the last cell may go on
                held = [rows[last:]]
                if last:
                    yield from flush(rows[:last])
        if held:
            yield from flush(np.concatenate(held))

    pairs = [d.select(*names).sortWithinPartitions(*names).mapInArrow(meet, "x long, y long") for d in dealt]
    return reduce(DataFrame.union, pairs).distinct()


def texts_of(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """(sk, comp, _text) of the documents of ``rows`` (__row, sk, comp), one for each set. Few rows, by a count, are broadcast."""
    few = rows.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(rows) if few else rows, "__row").select("sk", "comp", "_text")


def packed_texts(texts: DataFrame) -> DataFrame:
    """(sk, z): each text compressed, one for each set. Compressed texts are a fraction of their shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in in_slices(batches):
            found = [packer.compress(as_bytes(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sk"), pa.array(found, pa.binary())], ["sk", "z"])

    # Compressed before the shuffle that leaves one row for each set; the joins on sk use the same partitions.
    return texts.select("sk", "_text").mapInArrow(run, "sk long, z binary").dropDuplicates(["sk"])


def reaching(both: DataFrame, shingle: int, per_mille: int) -> DataFrame:
    """The pairs (x, y) of compressed texts (zx, zy) whose shingle sets reach the similarity, as links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        last: dict[str, tuple[int, np.ndarray]] = {}

        def hashes(side: str, sk: int, z: pa.Scalar) -> np.ndarray:
            if side not in last or last[side][0] != sk:  # neighbouring pairs often share a text
                last[side] = sk, np.unique(shingle_hashes(unpacker.decompress(z.as_py()), shingle))
            return last[side][1]

        for batch in in_slices(batches):
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            hit = np.zeros(len(x), bool)
            for i, (a, b) in enumerate(zip(x, y)):
                hx, hy = hashes("x", a, batch.column("zx")[i]), hashes("y", b, batch.column("zy")[i])
                shared = len(np.intersect1d(hx, hy, assume_unique=True))
                hit[i] = shared * (1000 + per_mille) >= (len(hx) + len(hy)) * per_mille
            kept = pa.array(hit)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(kept), batch.column("y").filter(kept)], ["a", "b"])

    return both.select("x", "y", "zx", "zy").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, least: DataFrame, keyed: DataFrame, shingle: int, per_mille: int) -> DataFrame:
    """Of the pairs (x, y) of set identities those whose shingle sets truly reach the similarity, as links (a, b).

    Bitmaps rule out most pairs, and never one that is similar, before any text is read.
    """
    x, y = (least.select(F.col("sk").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}")) for c in "xy")
    apart = F.aggregate(F.zip_with("bx", "by", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, v: a + v)
    total = F.col("nx") + F.col("ny")
    pairs = materialise(pairs.join(x, "x").join(y, "y").where((total - apart) * (1000 + per_mille) >= total * 2 * per_mille).select("x", "y"))
    ends = pairs.select(F.col("x").alias("sk")).union(pairs.select("y")).distinct()
    rows = materialise(least.join(ends, "sk", "left_semi").select(F.col("least.row").alias("__row"), "sk", F.col("sk").alias("comp")))
    packed = packed_texts(texts_of(keyed, rows))
    both = pairs.join(packed.select(F.col("sk").alias("x"), F.col("z").alias("zx")), "x").join(packed.select(F.col("sk").alias("y"), F.col("z").alias("zy")), "y")
    return reaching(both, shingle, per_mille)


def dedup_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = RADIUS, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, with all its columns unchanged.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least the threshold (in thousandths);
    a group is all that links join in steps. No such pair is missed. Texts without words are alike.
    Among rows of equal id and text, and among null ids, the smallest hash of the row stays; a null id comes last. An
    empty table gives no rows.
    """
    per_mille = round(threshold * 1000)
    keyed = carried(docs, id_col, text_col)
    marked = materialise(with_sets(keyed, "text_", "id_", shingle))
    # At most one row per bucket of the rarity table reaches the driver.
    rarity = np.zeros(RARITY_BUCKETS, np.int64)
    for r in marked.where("sk is null").groupBy("__row").agg(F.sum("n").alias("n")).collect():
        rarity[r["__row"]] = r["n"]
    first = F.min(F.struct(F.col("id_").isNull().alias("none"), F.col("id_").alias("id"), F.col("__row").alias("row")))
    least = materialise(marked.where("sk is not null").groupBy("sk").agg(first.alias("least"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits")))
    texts = keyed.select("__row", F.col("text_").alias("_text"))

    # Documents with close fingerprints meet the first one of their group.
    roots = connected_components(near_links(least.select("fp").distinct(), radius))
    rooted = least.select("sk", "fp").join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("sk", F.coalesce("root", "fp").alias("root"))
    centre = rooted.groupBy("root").agg(F.min("sk").alias("x"))
    close = rooted.join(centre, "root").where("sk <> x").select("x", F.col("sk").alias("y"))
    settled = materialise(similar(close, least, texts, shingle, per_mille))
    # The others meet by their rarest shingles; what is linked already need not meet again.
    comps = connected_components(settled).select(F.col("v").alias("sk"), "root")
    open_ = materialise(least.join(comps, "sk", "left").select(F.col("least.row").alias("__row"), "sk", F.coalesce("root", "sk").alias("comp")))
    links = settled.union(similar(prefix_pairs(texts_of(texts, open_), shingle, per_mille, rarity), least, texts, shingle, per_mille))

    groups = least.join(connected_components(links).withColumnRenamed("v", "sk"), "sk", "left").withColumn("root", F.coalesce("root", "sk"))
    kept = groups.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("__row"))
    return unpacked(keyed.join(kept, "__row", "left_semi"), docs.columns)
