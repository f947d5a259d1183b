"""The queries of the training-data operators: production parameters over whole tables.

``op1_line_dedup`` has SQL of its own. Of four others SQL can express a part of the result: each has a companion query
that goes through the same operator and returns those columns only. All else is tested in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, license_scan, line_dedup, order_minhash, packing, quality, runs, secret_scan, simhash, toxicity, warc, whitening
from .base import table, tokenizer_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of every document stay; each of them has no similar line before it in the corpus."""
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by pattern and by randomness."""
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, from labels outside the held-out fold."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-sensitive fingerprints of every document and of its edited text."""
    return order_minhash.edit_report(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of their decoding."""
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, from labels outside the held-out fold."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("notice_lines")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every vector, and how exact they are."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of which get a periodic tail first."""
    return runs.run_report(table(spark, sf_dir, "documents"))


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the secret scan that fixed patterns give."""
    return op4_secret_scan(spark, sf_dir).drop("spans")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts out of the fingerprint report."""
    return op7_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding byte-level tokens gives the text back."""
    return op9_bpe_round_trip(spark, sf_dir).select("doc_id", "decoded_sha256")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the license scan that fixed phrases give."""
    return op10_license_scan(spark, sf_dir).drop("labels", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_ann": op3_ann,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_order_minhash": op7_order_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_license_scan": op10_license_scan,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_periodic_runs": op13_periodic_runs,
    "secret_patterns": secret_patterns,
    "edited_texts": edited_texts,
    "decoded_texts": decoded_texts,
    "license_phrases": license_phrases,
}

#: Distinct lines by first place, their tokens from rare to common, pairs that share one in their prefixes, and of the
#: truly similar pairs the later line.
LINE_DEDUP = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as no from documents),
n as (select * from l where regexp_matches(line, '\S')),
d as (select line, min(doc_id::hugeint * 2147483648 + no) place from n group by line),
dd as materialized (select row_number() over (order by place) lid, place, list_distinct(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) ws from d),
t as materialized (select lid, unnest(ws) w, len(ws) sz from dd),
v as materialized (select w, count(*) c from t group by w),
pr as materialized (select lid, w, sz from (select *, row_number() over (partition by lid order by c, w) p from t join v using (w)) where p <= sz - ceil(round(sz * 0.8, 6)) + 1),
cand as (select distinct a.lid x, b.lid y from pr a join pr b on a.w = b.w and a.lid > b.lid and a.sz * 10 >= b.sz * 8 and b.sz * 10 >= a.sz * 8),
gone as (select distinct x lid from (select x, len(list_intersect(a.ws, b.ws)) o, len(a.ws) + len(b.ws) s from cand join dd a on a.lid = x join dd b on b.lid = y) where o * 18 >= s * 8),
kept as (select (place // 2147483648)::bigint doc_id, (place % 2147483648)::bigint as no from dd anti join gone using (lid)),
k as (select doc_id, count(*) n, string_agg(no::varchar, ',' order by no) kept_lines from kept group by doc_id),
f as (select doc_id, count(*) n from n group by doc_id)
select doc_id, len(string_split(coalesce(text, ''), chr(10)))::bigint n_lines, (coalesce(f.n, 0) - coalesce(k.n, 0))::bigint n_removed, coalesce(kept_lines, '') kept_lines
from documents left join k using (doc_id) left join f using (doc_id)"""

#: Matches in turn, with what splits there: starts are sums of lengths before.
_KINDS = [
    (0, "assign", r"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]+", r"^(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]{6,}$"),
    (1, "access", "AKIA[A-Z0-9]+", "^.{20,}$"),
    (2, "hex", "[0-9a-f]+", "^.{24,}$"),
]


def _spans_sql(kind: int, name: str, pattern: str, enough: str) -> str:
    found = f"regexp_extract_all(text, '{pattern}')"
    marked = f"string_split(regexp_replace(text, '{pattern}', chr(1), 'g'), chr(1))"
    return f"""select doc_id, {kind} kind, '{name}' as name, m, (list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[:i - 1], lambda x: length(x))), 0))::bigint s
    from (select doc_id, f, g, unnest(f) m, generate_subscripts(f, 1) i from (select doc_id, {found} f, {marked} g from t)) where regexp_matches(m, '{enough}')"""


SECRET_PATTERNS = f"""with t as (select doc_id, coalesce(text, '') as text from documents), m as ({" union all ".join(_spans_sql(*k) for k in _KINDS)}),
a as (select doc_id, count(*) filter (where kind = 0) n_assign, count(*) filter (where kind = 1) n_access, count(*) filter (where kind = 2) n_hex, string_agg(name || ':' || s || ':' || (s + length(m)), ',' order by s, kind) spans from m group by doc_id)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(spans, '')) base_sha256 from t left join a using (doc_id)"""

EDITED_TEXTS = """select doc_id, length(t)::bigint n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)), 1, length(t) // 3)) edited_sha256
from (select doc_id, coalesce(text, '') t from documents)"""

DECODED_TEXTS = "select doc_id, sha256(coalesce(text, '')) decoded_sha256 from documents"

_PLACES = " union all ".join(
    f"select doc_id, i - 1 as place, '{label}' as label from (select doc_id, ws, generate_subscripts(ws, 1) i from w where list_contains(ws, '{phrase.split(' ')[0]}')) where ws[i:i + {len(phrase.split(' ')) - 1}] = {phrase.split(' ')}" for phrase, label in license_scan.PHRASES.items()
)
LICENSE_PHRASES = f"""with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') ws from documents),
p as ({_PLACES}), a as (select doc_id, count(*) n_base, min(place) first_word, max(place) last_word, string_agg(distinct label, ',' order by label) base_labels from p group by doc_id)
select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels from w left join a using (doc_id)"""

#: What the archives must give back.
WARC = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) f from p where payload_bytes >= 100 group by all)
select page_id, payload_bytes::bigint payload_bytes, payload_digest, case when f is null or f = page_id then 'response' else 'revisit' end record_type, nullif(f, page_id) refers_to from p left join f using (payload_digest)"""

ORACLE_SQL: dict[str, str] = {
    "op12_warc": WARC,
    "op1_line_dedup": LINE_DEDUP,
    "secret_patterns": SECRET_PATTERNS,
    "edited_texts": EDITED_TEXTS,
    "decoded_texts": DECODED_TEXTS,
    "license_phrases": LICENSE_PHRASES,
}
