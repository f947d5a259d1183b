"""Expressions on headers, sequences and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted letters of sequences and the printable range of qualities.
ALPHABETS = {"iupac": "ACGTURYSWKMBDHVNacgturyswkmbdhvn", "acgtn": "ACGTNacgtn"}
QUALITY_CLASS = "[!-~]"
#: Sequences whose first match is counted as adapter content.
CONTENT_ADAPTERS = {
    "Illumina Universal Adapter": "AGATCGGAAGAG",
    "Illumina Small RNA 3' Adapter": "TGGAATTCTCGG",
    "Illumina Small RNA 5' Adapter": "GATCGTCGGACT",
    "Nextera Transposase Sequence": "CTGTCTCTTATA",
    "PolyA": "AAAAAAAAAAAA",
    "PolyG": "GGGGGGGGGGGG",
}


def record_id(header: Column) -> Column:
    """The first token of a header."""
    return F.regexp_extract(header, r"^[^ \t]*", 0)


def letters(text: Column, which: str) -> Column:
    """How often any of the given letters stands in the text."""
    return F.length(text) - F.length(F.translate(text, which, ""))


def first_outside(text: Column, klass: str) -> Column:
    """Index from 0 of the first character outside a character class, or null."""
    ok = F.length(F.regexp_extract(text, f"^{klass}*", 0))
    return F.when(ok < F.length(text), ok)


def bad_base_index(seq: Column, alphabet: str = "iupac") -> Column:
    return first_outside(seq, f"[{ALPHABETS[alphabet]}]")


def bad_quality_index(qual: Column) -> Column:
    return first_outside(qual, QUALITY_CLASS)


def scores(qual: Column) -> Column:
    """Array of Phred scores."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)


def at_least(qual: Column, score: int) -> Column:
    """Bases with a score of at least ``score``."""
    return F.length(qual) - F.length(F.regexp_replace(qual, f"[\\x{33 + score:02x}-\\x7e]", ""))


def reverse_complement(seq: Column) -> Column:
    """Upper case; whatever is not A, C, G or T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def second_token(header: Column) -> Column:
    return F.regexp_extract(header, r"^[^ \t]*[ \t]+([^ \t]+)", 1)


def normalised_id(header: Column, policy: str = "illumina") -> Column:
    """The read's name without a trailing mate mark."""
    name = record_id(header)
    return F.regexp_replace(name, "/[12]$", "") if policy == "illumina" else name


def mate_marks(header: Column) -> Column:
    """Bit mask of the mates that a header names: 1, 2, both (3) or none (0)."""
    name, rest = record_id(header), second_token(header)
    says = lambda k: name.rlike(f"/{k}$") | rest.rlike(f"^{k}:") | rest.rlike(f"/{k}$")
    return F.when(says(1), 1).otherwise(0) + F.when(says(2), 2).otherwise(0)


def names_match(first: Column, second: Column, policy: str = "illumina") -> Column:
    """Whether two headers name the two mates of one pair."""
    same = (normalised_id(first, policy) == normalised_id(second, policy)) & (normalised_id(first, policy) != "")
    if policy == "exact":
        return same
    a, b = mate_marks(first), mate_marks(second)
    return same & (((a == 0) & (b == 0)) | ((a == 1) & (b == 2)))


def gc_kept_length(n: Column) -> Column:
    return F.when(n > 1000, F.floor(n / 1000) * 1000).when(n > 100, F.floor(n / 100) * 100).otherwise(n).cast("int")


def tag_header(header: Column, tag: Column) -> Column:
    """Inserts a tag at the end of the name, before a trailing mate mark."""
    name = record_id(header)
    mark = F.regexp_extract(name, "/[12]$", 0)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(mark))
    return F.concat(stem, tag, mark, F.substring(header, F.length(name) + 1, F.length(header)))


def tag_plus(plus: Column, header: Column, tag: Column) -> Column:
    """A plus line that repeats the header (without its @) gets the tag too; others stay."""
    bare = F.regexp_replace(header, "^@", "")
    return F.when(F.length(plus) > 1, F.when(F.substring(plus, F.lit(2), F.length(plus)) == bare, F.concat(F.lit("+"), tag_header(bare, tag))).otherwise(plus)).otherwise(plus)


def escaped_bytes(text: Column) -> Column:
    """Printable ASCII as it is, a backslash twice, and any other byte as \\xHH."""
    shown = lambda h: F.when(h == "5C", "\\\\").when((h >= "20") & (h <= "7E"), F.decode(F.unhex(h), "US-ASCII")).otherwise(F.concat(F.lit("\\x"), h))
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), shown), "")
