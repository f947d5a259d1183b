"""Corpus-wide line deduplication as an exact set-similarity join, in DataFrame operations only.

A line is a set of white-space separated tokens. It goes if an earlier line (by document, then place) has a Jaccard
similarity of at least the threshold; equal lines are the simplest case. Steps:

1. Tokens are counted over the whole corpus in a table of fixed size, by the bucket of their hash: the order of rarity.
2. Equal lines become one row that knows its first place (grouped by the line itself). The row gets the line's rarest
   tokens in that order: two similar lines share a token among the first few of each (prefix filter). It also gets the
   size of the token set and a parity bitmap, which bounds from below by how many tokens two lines differ. This table
   is written once; the later steps read the columns they need.
3. Every line meets, by its rarest few tokens, a few of the earliest lines that hold such a token, and is compared with
   the few most alike of them. Open lines then meet those lines to which several others were alike, by all tokens of
   their prefixes. That settles almost all lines of large groups of near copies, whose pairs therefore are never enumerated.
4. Open lines meet each other and the settled ones that come before them, by all their prefix tokens and in turns by
   size: the longer of the
   two by its whole prefix, the shorter by the part that suffices then. Length, positional and bitmap filters sift the
   pairs, and those left are verified on the tokens themselves.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import among, materialise, order_of, stored

THRESHOLD = 0.8
#: Buckets of the rarity table, whatever the size of the corpus; a power of two.
RARITY_BUCKETS = 1 << 18
#: By how many of its tokens each line first meets others, and how many lines it meets by each.
FIRST_TOKENS, FIRST_LINES = 2, 4
#: How many others must be alike to a line, so that open lines meet it by all its prefix tokens.
CENTRE = 8
#: With how many of the lines that it meets so, the most alike ones by their bitmaps, a line is compared.
ALIKE = 3
#: Sizes of token sets at which the turns begin in which open lines meet: each turn's shuffle files go before the next.
TURNS = (0, 48, 84)
#: Token sets larger than this have a bitmap of 128 bits, the others one of 64.
LONG_LINE = 64
OTHER_SPACE = "\t\x0b\f\r"


def split_tokens(text: Column) -> Column:
    """The white-space separated parts of a text, empty ones among them. White space other than blanks is rare in lines."""
    other = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in OTHER_SPACE))  # searches bytes; a pattern decodes the text
    return F.split(F.when(other, F.regexp_replace(text, r"\s", " ")).otherwise(text), " ")


def tokens_of(line: str | Column) -> Column:
    """The distinct tokens of a line."""
    return F.array_remove(F.array_distinct(split_tokens(F.col(line) if isinstance(line, str) else line)), "")


def bucket_of(token_hash: Column) -> Column:
    return token_hash.bitwiseAND(RARITY_BUCKETS - 1).cast("int")


def rarity_table(docs: DataFrame, text_col: str) -> str:
    """For each bucket of token hashes a class from 0 (unused) to 90: two steps for each doubling of the count; comma-joined.

    Counted over all texts, split at blanks and line ends. The counts give an order and nothing else: no token is left out
    for being rare, so that they needn't know other white space. The driver receives the classes as text, three characters
    per bucket, 4096 buckets a row.
    """
    token = docs.select(F.explode(F.split(F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")), " ")).alias("t"))
    counts = token.select(bucket_of(F.xxhash64("t")).alias("b")).groupBy("b").count()
    step = F.least(F.lit(90), 1 + F.floor(2 * F.log2("count")).cast("int"))
    mark = lambda v: F.char(v + 32)
    place = F.col("b").bitwiseAND(4095)
    coded = F.concat(mark(F.shiftright(place, 6)), mark(place.bitwiseAND(63)), mark(step))
    packed = counts.groupBy(F.shiftright("b", 12).alias("row")).agg(F.array_join(F.collect_list(coded), "").alias("text")).collect()
    classes = np.zeros(RARITY_BUCKETS, np.uint8)
    for row, text in packed:
        high, low, step = np.frombuffer(text.encode("ascii"), np.uint8).reshape(-1, 3).T.astype(np.int64) - 32
        classes[row * 4096 + high * 64 + low] = step
    return ",".join(map(str, classes.tolist()))


def least_overlap(sizes: Column, threshold: float) -> Column:
    """Tokens that two lines of together ``sizes`` tokens must share."""
    return F.ceil(F.round(sizes * (threshold / (1 + threshold)), 6))


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct line that isn't blank: ``line`` and ``at``, its first place as one number that sorts by
    document, then by a hash of its text (which tells rows of one id apart), then by line."""
    keyed = docs.select(*doc_key(docs, id_col, text_col), F.col(text_col).alias("text_")).select(place_of(F.col("ord"), F.col("tie")).alias("base_"), F.posexplode(F.split("text_", "\n")).alias("no", "line"))
    return keyed.where(F.col("line").rlike(r"\S")).groupBy("line").agg(F.min((F.col("base_") + F.col("no")).cast("decimal(38,0)")).alias("at"))


def doc_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """ord and tie of each row. A null id is replaced by a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(order_of(docs, id_col), F.xxhash64(text)).alias("ord"), F.hash(text).alias("tie")]


#: Line numbers of a document, and keys of one id: the parts of a line's place below the id.
_LINES, _BELOW = 1 << 31, Decimal(1 << 63)


def place_of(ord_: Column, tie: Column) -> Column:
    """A number of 126 bits that sorts by ord, then by tie, with room for a line number."""
    below = (tie.cast("long") + (1 << 31)) * _LINES
    return (ord_.cast("decimal(19,0)") * F.lit(_BELOW) + below.cast("decimal(19,0)")).cast("decimal(38,0)")


def placed(lines: DataFrame) -> DataFrame:
    """ord, tie and no out of ``at``. The remainder comes off first: decimal division rounds, and only whole quotients are exact."""
    d = lines.withColumn("low_", F.pmod("at", F.lit(_BELOW))).withColumn("rest_", F.col("low_").cast("long"))
    d = d.withColumn("ord", ((F.col("at") - F.col("low_")) / F.lit(_BELOW)).cast("long"))
    return d.withColumn("tie", (F.shiftrightunsigned("rest_", 31) - (1 << 31)).cast("int")).withColumn("no", F.col("rest_").bitwiseAND(_LINES - 1).cast("int")).drop("low_", "rest_", "at")


def coded(lines: DataFrame, rarity: str, threshold: float) -> DataFrame:
    """Adds n (distinct tokens), w0 and w1 (the parity bitmap), and prefix (codes of the rarest tokens, rare ones first).

    A token becomes its code at once; no later step takes an array with possible nulls, so that codes are sorted as plain
    numbers. The bits of a token are the lowest of its code.
    """
    ranks = F.split(F.lit(rarity), ",").cast("array<int>")  # folded into one constant

    def code(h: Column) -> Column:  # sorts by rarity class, then by the hash
        return F.shiftleft(F.coalesce(F.get(ranks, bucket_of(h)), F.lit(0)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    def flip(bit: Column, place: Column) -> Column:
        return F.call_function("shiftleft", bit, place.bitwiseAND(63).cast("int"))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    hashes = F.array_distinct(F.transform(split_tokens(F.col("line")), lambda token: F.xxhash64(token)))
    codes = F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), code)
    d = lines.withColumn("codes_", F.sort_array(codes)).withColumn("n", F.size("codes_"))
    d = d.withColumn("all_", F.aggregate("codes_", zero, lambda acc, c: acc.bitwiseXOR(flip(one, c))))
    second = F.aggregate("codes_", zero, lambda acc, c: acc.bitwiseXOR(flip(F.shiftrightunsigned(c, 6).bitwiseAND(one), c)))
    d = d.withColumn("w1", F.when(F.col("n") > LONG_LINE, second).otherwise(zero)).withColumn("w0", F.col("all_").bitwiseXOR(F.col("w1")))
    return d.withColumn("prefix", F.slice("codes_", F.lit(1), prefix_length(F.col("n"), threshold))).drop("all_", "codes_")


def prefix_length(n: Column, threshold: float) -> Column:
    """Tokens by which a line may meet one that is no larger."""
    return n - F.ceil(F.round(n * threshold, 6)).cast("int") + 1


def index_length(n: Column, threshold: float) -> Column:
    """Tokens by which a line may meet one that is no smaller: the two must share more, so that fewer suffice."""
    return n - least_overlap(n * 2, threshold).cast("int") + 1


#: What a prefix row knows of its line, and of the token's place in it: ``np`` holds the size, the place and whether the
#: place is in the shorter prefix, so that a row stays short.
ABOUT = ["lid", "ord", "np", "w0", "w1"]


def prefix_rows(lines: DataFrame, threshold: float, most: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per prefix token (the rarest ``most`` only): tok, ABOUT and what is to be kept."""
    own = ["lid", "ord", "n", "w0", "w1", *keep]
    rows = lines.select(*own, index_length(F.col("n"), threshold).alias("i_"), F.posexplode("prefix" if most is None else F.slice("prefix", 1, most)).alias("p", "tok"))
    packed = F.col("n").cast("long") * (1 << 32) + F.col("p").cast("long") * 2 + (F.col("p") < F.col("i_")).cast("long")
    return rows.select("tok", "lid", "ord", packed.alias("np"), "w0", "w1", *keep)


def size_of(np: str) -> Column:
    return F.shiftright(np, 32)


def in_index(np: str) -> Column:
    return F.col(np).bitwiseAND(1) == 1


def apart(x: str, y: str) -> Column:
    """By how many tokens two lines differ at least, for columns with suffixes x and y."""
    x0, x1, y0, y1 = (F.col(c) for c in (f"w0{x}", f"w1{x}", f"w0{y}", f"w1{y}"))
    wide = F.bit_count(x0.bitwiseXOR(y0)) + F.bit_count(x1.bitwiseXOR(y1))
    narrow = F.bit_count(x0.bitwiseXOR(x1).bitwiseXOR(y0).bitwiseXOR(y1))
    return F.when((size_of(f"np{x}") > LONG_LINE) & (size_of(f"np{y}") > LONG_LINE), wide).otherwise(narrow)


def alike(x: str, y: str, threshold: float) -> Column:
    """Length filter and bitmap filter, for columns with suffixes x and y.

    In whole numbers, with the threshold in thousandths rounded down; the verification uses the threshold itself.
    """
    t = int(threshold * 1000 + 1e-9)
    n, m = size_of(f"np{x}"), size_of(f"np{y}")
    return (n * 1000 >= m * t) & (m * 1000 >= n * t) & ((n + m) * (2 * t) <= (n + m - apart(x, y)) * (1000 + t))


def in_reach(x: str, y: str, threshold: float) -> Column:
    """Positional filter for a shared token. It takes the token for the first that the lines share, so that only the
    tokens from it on count: a pair passes at its first shared token, if it can be similar at all, and may fail at others."""
    t = int(threshold * 1000 + 1e-9)
    n, m = size_of(f"np{x}"), size_of(f"np{y}")
    p, q = (F.shiftright(F.col(c).bitwiseAND((1 << 32) - 1), 1) for c in (f"np{x}", f"np{y}"))
    return F.least(n - p, m - q) * (1000 + t) >= (n + m) * t


def later_of(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Of each pair (x, y) of line ids that truly is similar, the later line: column ``lid``, distinct.

    Only the texts of lines in pairs are shuffled, and each is split once, before it meets the others.
    """
    ids = materialise(pairs.select(F.col("x").alias("lid")).union(pairs.select("y")).distinct())
    text = among(lines.select("lid", F.struct("ord", "tie", "no").alias("at"), "line"), ids, "lid").select("lid", "at", tokens_of("line").alias("t"))
    x, y = (text.select(*(F.col(c).alias(f"{c}_{side}") for c in text.columns)) for side in "xy")
    both = pairs.join(x, F.col("x") == F.col("lid_x")).join(y, F.col("y") == F.col("lid_y"))
    both = both.select("x", "y", (F.col("at_x") < F.col("at_y")).alias("first"), "t_x", "t_y")
    true = both.where(F.size(F.array_intersect("t_x", "t_y")) >= least_overlap(F.size("t_x") + F.size("t_y"), threshold))
    return true.select(F.when(F.col("first"), F.col("y")).otherwise(F.col("x")).alias("lid")).distinct()


def sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("tok", *(F.col(c).alias(c + side) for c in rows.columns if c != "tok"))


def earliest(rows: DataFrame, lines: int) -> DataFrame:
    """For each token a few of the earliest lines that hold it. These are aggregates, combined before they are shuffled: a
    token that very many lines hold is nowhere gathered."""
    of_least = lambda c: F.min_by(c, "ord").alias(c) if c != "ord" else F.min("ord").alias("ord")
    return rows.groupBy("tok", F.col("lid").bitwiseAND(lines - 1).alias("c_")).agg(*map(of_least, ABOUT)).drop("c_")


def alike_pairs(later: DataFrame, earlier: DataFrame, threshold: float) -> DataFrame:
    """For each line x of ``later`` the most alike of the lines of ``earlier`` that share a token, as pairs (x, y), ALIKE at
    most. ``earlier`` has a few rows for each token, which bounds what is gathered for a line."""
    met = sided(later, "_x").join(sided(earlier, "_y"), "tok")
    met = met.where((F.col("lid_x") != F.col("lid_y")) & (F.col("ord_x") >= F.col("ord_y")) & alike("_x", "_y", threshold))
    found = met.groupBy(F.col("lid_x").alias("x")).agg(F.array_sort(F.collect_set(F.struct(apart("_x", "_y").alias("apart"), F.col("lid_y").alias("y")))).alias("y"))
    return found.select("x", F.explode(F.slice("y", 1, ALIKE)["y"]).alias("y"))


def settled_lines(lines: DataFrame, threshold: float) -> DataFrame:
    """Lines that are similar to an earlier one which they meet in two rounds: by each line's rarest tokens, then by all
    prefix tokens of the earliest lines to which several others were alike in the first round. What the rounds miss stays open."""
    rare = prefix_rows(lines, threshold, FIRST_TOKENS)
    pairs = materialise(alike_pairs(rare, earliest(rare, FIRST_LINES), threshold))
    settled = materialise(later_of(pairs, lines, threshold))
    centres = materialise(pairs.groupBy(F.col("y").alias("lid")).count().where(F.col("count") >= CENTRE).select("lid"))
    of_centres = materialise(prefix_rows(among(lines, centres, "lid"), threshold).where(in_index("np")))
    toks = materialise(of_centres.select("tok").distinct())
    rest = among(prefix_rows(among(lines, settled, "lid", "left_anti"), threshold).where(in_index("np")), toks, "tok")
    more = materialise(alike_pairs(rest, earliest(of_centres, FIRST_LINES), threshold))
    return materialise(settled.union(later_of(more, lines, threshold)).distinct())


def open_pairs(lines: DataFrame, low: int, high: float, threshold: float) -> DataFrame:
    """All pairs that can be similar and of which the later line may be open, for lines x of ``low`` to below ``high`` tokens.

    ``lines`` has the flag ``settled``. The other line's size is in a range about that of x, by the length filter.
    """
    t = int(threshold * 1000 + 1e-9)
    n = F.col("n")
    longer = sided(prefix_rows(lines.where(~F.col("settled") & (n >= low) & (n < high)), threshold), "_x")
    other = prefix_rows(lines.where((n * 1000 >= low * t) & (n * t < high * 1000)), threshold, keep=("settled",))
    other = sided(other.where(F.col("settled") | in_index("np")), "_y")
    n, m = size_of("np_x"), size_of("np_y")
    # Of two open lines the one with more tokens is x. A settled line is y, whatever its size, and the earlier one.
    among_open = (n > m) | ((n == m) & (F.col("lid_x") > F.col("lid_y")) & in_index("np_x"))
    before = (F.col("ord_x") >= F.col("ord_y")) & ((n >= m) | in_index("np_x")) & ((n <= m) | in_index("np_y"))
    meet = (F.col("lid_x") != F.col("lid_y")) & in_reach("_x", "_y", threshold) & alike("_x", "_y", threshold) & F.when(F.col("settled_y"), before).otherwise(among_open)
    return longer.join(other, "tok").where(meet).select(F.col("lid_x").alias("x"), F.col("lid_y").alias("y")).distinct()


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For each document with kept lines: ord and tie (its key) and ``kept``, the numbers of its kept lines."""
    rarity = rarity_table(docs, text_col)
    lines = coded(placed(distinct_lines(docs, id_col, text_col)), rarity, threshold).withColumn("lid", F.monotonically_increasing_id())
    lines = stored(lines)
    settled = settled_lines(lines, threshold)
    narrow = lines.drop("tie", "no", "line")
    marked = among(narrow, settled.withColumn("settled", F.lit(True)), "lid", "left").withColumn("settled", F.col("settled").isNotNull())
    turns = [materialise(open_pairs(marked, low, high, threshold)) for low, high in zip(TURNS, (*TURNS[1:], float("inf")))]
    more = later_of(reduce(DataFrame.union, turns).distinct(), lines, threshold)
    gone = materialise(settled.union(more).distinct())
    kept = among(lines.select("lid", "ord", "tie", "no"), gone, "lid", "left_anti")
    return kept.groupBy("ord", "tie").agg(F.collect_list("no").alias("kept"))


def line_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_lines (numbers from 0, comma-joined, blank lines left out).

    Blank lines (nothing but white space) are neither compared nor removed. Null and empty texts have one blank line.
    Rows of equal id come in the order of a hash of their texts; rows equal in id and text count as one document. A row
    without an id has a hash of its text for an id. Further columns are not read. An empty table gives no rows.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    counted = docs.select(F.col(id_col).alias("doc_id"), *doc_key(docs, id_col, text_col), F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: x.rlike(r"\S"))).alias("full_"))
    found = counted.join(kept_lines(docs, id_col, text_col, threshold), ["ord", "tie"], "left")
    stay = F.coalesce("kept", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", (F.col("full_") - F.size(stay)).cast("long").alias("n_removed"), F.array_join(F.sort_array(stay).cast("array<string>"), ",").alias("kept_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All documents with all their columns; removed lines are gone from the text, blank lines stay. Null texts stay null.

    Ties, repeated rows and rows without an id are treated as in ``line_dedup_report``; columns may have any names.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("doc"), *doc_key(docs, id_col, text_col)).join(kept_lines(docs, id_col, text_col, threshold), ["ord", "tie"], "left")
    text = F.col("doc").getField(text_col)
    keyed = keyed.withColumn("lines_", F.split(text, "\n"))
    blank = F.filter(F.transform("lines_", lambda x, i: F.when(~x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    keyed = keyed.withColumn("stay_", F.sort_array(F.array_distinct(F.concat(blank, F.coalesce("kept", F.array().cast("array<int>"))))))
    joined = F.when(text.isNotNull(), F.array_join(F.transform("stay_", lambda i: F.get("lines_", i)), "\n"))
    return keyed.withColumn("text_", joined).select(*(F.col("text_").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in names))
