"""Secret scans in DataFrame operations only: fixed patterns, and a randomness test battery for strings without one.

Candidates of the battery are long runs of encoding symbols whose encoding can be inferred (hexadecimal, base 32,
base 36, base 64); an equals sign ends a run and belongs to it only as padding. Each is tested for what an encoded random
secret shows: equal use of the alphabet (chi-squared over bins of symbols that words use to different degrees), as many runs
of one class of symbols as chance gives, and no serial correlation (of vowels with their neighbours, and of classes two and
three places apart). Fisher's method combines the p-values to one score, low for what looks random.

What is to be kept out is structured text: names, paths and slugs. Its scores are measured: all words of every text,
written like names in every form and at the lengths of every band that has candidates, and a fixed list of usual words
gives some more, so that there are enough in any table. A string's further tests are left out once the first ones show
that its score is above what can be reported, which changes no share that the rule uses.
Within each band of lengths a candidate's p-value is the share of structured strings with a score as low as its own, in
the form of names where that share is greatest, and
Benjamini and Hochberg's rule on these reports candidates so that at most the given share of reports is structured text.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, whole_text

#: The kinds in their order, their patterns, and what a match must have. Letters of the keywords stand in either case.
KINDS = ["assign", "access", "hex", "random"]
KEYWORDS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORDS + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Letters by how usual they are in words; letters of one group, and of one case, are one bin of the chi-squared test.
LETTER_GROUPS = ["etaoinsr", "hldcumfp", "gwybvkxjqz"]
VOWELS = "aeiou"
#: Usual parts of names, from which structured strings are made beside those of the texts.
NAME_WORDS = "get set user account balance history update delete create find load save parse render handle request response server client buffer stream index table column value string number config option manager service provider context session event listener message queue worker thread process system file path image button label window panel test case result report invoice customer order product price total amount date status error level".split()
NAMES_PER_BAND = 300
#: The words of a text are taken in stretches of so many, each of which is written as a name in each form and cut to each length.
STRETCH_WORDS, FORMS = 30, 3
FALSE_DISCOVERY = 0.05
#: Lengths at which the bands of the false-discovery control begin.
BANDS = [20, 32, 48, 64, 128]
#: Steps of the histogram of scores, and how many make one.
STEPS, PER_POINT = 1200, 10
#: Up to which step the shares of structured strings are first measured; beyond it only where that doesn't decide.
FIRST_STEPS = 160
PLACEHOLDER = "[SECRET]"


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def with_spans(d: DataFrame, name: str, pattern: str, block: int = 256) -> DataFrame:
    """Adds the array ``name`` of (start, end, found): all leftmost non-overlapping matches in ``text_``, in code points.

    Starts are sums of the lengths of what matches and of what splits there. They are summed by blocks, so that a text
    with very many matches stays affordable. Every step is a column of its own, worked out once for each text.
    """
    has, none = F.col("text_").rlike(pattern), F.array().cast("array<string>")
    d = d.withColumn("f_", F.when(has, F.regexp_extract_all("text_", F.lit(pattern), 0)).otherwise(none))
    d = d.withColumn("g_", F.when(F.size("f_") > 0, F.split("text_", pattern, -1)).otherwise(none))
    d = d.withColumn("s_", F.zip_with("f_", F.slice("g_", F.lit(1), F.size("f_")), lambda m, g: F.length(m) + F.length(g)))
    d = d.withColumn("b_", F.transform(F.sequence(F.lit(0), F.floor(F.size("s_") / block).cast("int")), lambda b: total(F.slice("s_", b * block + 1, F.lit(block)))))

    def place(m: Column, i: Column) -> Column:
        b = F.floor(i / block).cast("int")
        end = total(F.slice("b_", F.lit(1), b)) + total(F.slice("s_", b * block + 1, i - b * block + 1))
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("found"))

    return d.withColumn(name, F.transform("f_", place)).drop("f_", "g_", "s_", "b_")


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, by the usual rational approximation (error below 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def bins_of(alphabet: str) -> dict[str, str]:
    """For each symbol of an alphabet the bin of the chi-squared test, as a letter."""
    group = lambda c: next(i for i, g in enumerate(LETTER_GROUPS) if c.lower() in g)
    return {c: "g" if c.isdigit() else "h" if not c.isalpha() else "abc"[group(c)] if c.islower() else "def"[group(c)] for c in alphabet}


def class_of(symbol: str) -> str:
    return "d" if symbol.isdigit() else "s" if not symbol.isalpha() else "l" if symbol.islower() else "u"


def shares(marks: list[str]) -> dict[str, float]:
    return {m: marks.count(m) / len(marks) for m in sorted(set(marks))}


def marked(text: Column, mark: dict[str, str]) -> Column:
    return F.translate(text, "".join(mark), "".join(mark.values()))


def count_in(text: Column, pattern: str) -> Column:
    """How many characters match where they stand (the pattern takes one and may look ahead)."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def count_of(text: Column, part: str) -> Column:
    """How often a part stands in a text, for parts that can't overlap themselves: without a pattern, which costs several times as much."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def deviations(kind: str) -> dict[str, Column]:
    """By how many standard deviations the tests of one encoding differ from chance, from the counts that ``with_battery`` makes."""
    alphabet, n = ALPHABETS[kind], F.col("n_").cast("double")
    bins, classes = shares(list(bins_of(alphabet).values())), shares([class_of(c) for c in alphabet])
    chi = sum(F.pow(F.col(f"bin_{b}") - n * share, F.lit(2.0)) / (n * share) for b, share in bins.items())
    df = len(bins) - 1.0
    uniform = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
    same = sum(p * p for p in classes.values())
    apart = 1 - same
    joint = sum(p * (1 - p) ** 2 for p in classes.values()) - apart * apart  # covariance of neighbouring changes of class
    runs = (F.col("changes_") - (n - 1) * apart) / F.sqrt((n - 1) * apart * same + 2 * (n - 2) * joint)
    later = n * 2 - 5
    echoes = (F.col("echo_") - later * same) / F.sqrt(later * same * apart)
    return {"uniform": uniform, "runs": runs, "echoes": echoes}


def with_battery(cands: DataFrame, upto: Column | None = None) -> DataFrame:
    """Adds ``encoding``, ``score`` (Fisher's sum of the tests) and ``p`` (the chance that a random string scores as high) to
    rows with ``found``; null where no encoding is inferred.

    With ``upto``, a step, scores of later steps need not be exact: the tests end when those done show that the score's step
    is later, and their sum, which is no greater than the score, stands for it.
    """
    d = cands.withColumn("s_", F.regexp_replace(F.translate("found", "-_", "+/"), "=+$", ""))
    s = F.col("s_")
    kinds = F.when(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & s.rlike("[a-fA-F]") & s.rlike("[0-9]"), F.lit("hex"))
    kinds = kinds.when(s.rlike("^(?:[A-Z2-7]+|[a-z2-7]+)$") & s.rlike("[2-7]") & s.rlike("[A-Za-z]"), F.lit("base32"))
    kinds = kinds.when(s.rlike("^(?:[A-Z0-9]+|[a-z0-9]+)$") & s.rlike("[0-9]") & s.rlike("[A-Za-z]"), F.lit("base36"))
    kinds = kinds.when(s.rlike("^[A-Za-z0-9+/]+$") & s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]"), F.lit("base64"))
    d = d.withColumn("encoding", F.when(F.length("s_") >= BANDS[0], kinds))
    d = d.withColumn("s_", F.when(F.col("encoding") == "base64", s).otherwise(F.lower("s_"))).withColumn("n_", F.length("s_"))
    every = ALPHABETS["base64"]

    def by_kind(test: str) -> Column:
        value = F.lit(None).cast("double")
        for kind in ALPHABETS:
            value = F.when(F.col("encoding") == kind, deviations(kind)[test]).otherwise(value)
        return value

    log = lambda test: F.when(F.col(test).isNotNull(), F.log(F.greatest(F.col(test), F.lit(1e-12))))
    fisher = lambda *tails: -sum(map(log, tails))
    still = lambda part, value: value if upto is None else F.when(step_of(F.col(part)) <= upto, value)
    d = d.withColumn("b_", marked(s, bins_of(every))).withColumns({f"bin_{b}": count_of(F.col("b_"), b) for b in sorted(set(bins_of(every).values()))})
    d = d.withColumn("uniform", by_kind("uniform")).withColumn("uniform", upper_tail(F.col("uniform"))).withColumn("one_", fisher("uniform"))
    d = d.withColumns({"c_": still("one_", marked(s, {c: class_of(c) for c in every})), "v_": still("one_", marked(s, {c: str(int(c.lower() in VOWELS)) for c in every}))})
    classes = sorted({class_of(c) for c in every})
    counts = {"changes_": sum(count_of(F.col("c_"), x + y) for x in classes for y in classes if x != y)}
    first, ones = F.substring("v_", 1, 1).cast("int"), count_of(F.col("v_"), "1")
    counts |= {"ones_": ones.cast("double"), "near_": ones - first - count_of(F.col("v_"), "01"), "ends_": first + F.substring("v_", -1, 1).cast("int")}
    d = d.withColumns(counts).withColumn("mean_", F.col("ones_") / F.col("n_"))
    # The vowels' correlation with their neighbours is the same for every encoding.
    n, ones, mean = F.col("n_"), F.col("ones_"), F.col("mean_")
    d = d.withColumn("energy_", ones - n * mean * mean).withColumn("lagged_", F.col("near_") - mean * (2 * ones - F.col("ends_")) + (n - 1) * mean * mean)
    d = d.withColumn("serial", F.when(F.col("energy_") > 0, (F.col("lagged_") / F.col("energy_") + 1 / n) * F.sqrt(n)).when(F.col("energy_").isNotNull(), 0.0)).withColumn("runs", by_kind("runs"))
    two_sided = lambda test: 2 * upper_tail(F.abs(test))
    d = d.withColumns({"runs": two_sided("runs"), "serial": two_sided("serial")}).withColumn("three_", fisher("uniform", "runs", "serial"))
    c = still("three_", F.col("c_"))
    d = d.withColumn("echo_", count_in(c, r"(.)(?=.\1)") + count_in(c, r"(.)(?=..\1)")).withColumn("echoes", by_kind("echoes")).withColumn("echoes", two_sided("echoes"))
    score = fisher("uniform", "runs", "echoes", "serial")
    d = d.select(*cands.columns, "encoding", F.when(F.col("encoding").isNotNull(), score if upto is None else F.coalesce(score, "three_", "one_")).alias("score"))
    half = F.col("score")  # of Fisher's statistic, with eight degrees of freedom
    return d.withColumn("p", F.exp(-half) * (1 + half + half * half / 2 + half * half * half / 6))


def name_strings(spark: SparkSession) -> DataFrame:
    """Structured strings of usual words, so many for each band: the same ones everywhere."""
    rng, rows = random.Random(0), []
    for low in BANDS:
        for i in range(NAMES_PER_BAND):
            size, words = rng.randrange(low, low * 8 // 5), []
            while sum(map(len, words)) < size:
                words.append(rng.choice(NAME_WORDS))
            cased = "".join(w.capitalize() for w in words), "".join(words), "/".join(w.capitalize() if rng.random() < 0.5 else w for w in words)
            rows.append((cased[i % 3][:size] + str(rng.randrange(1, 2000)), i % 3))
    return spark.createDataFrame(rows, "found string, form int")


def text_strings(texts: DataFrame, every: bool = False) -> DataFrame:
    """Structured strings out of all words of every text of ``text_``: each stretch of words is written as one name, which is
    cut into parts of even length with a number. With ``every`` it is written in all forms, each cut to the lengths of all
    bands (once, if lengths give the same parts); else in one form and length, and every letter is in one string. Strings
    of fewer symbols than a candidate has are not scored."""
    stretch = f"(?:[A-Za-z]+[^A-Za-z]*){{1,{STRETCH_WORDS}}}"
    d = texts.select(F.explode(F.regexp_extract_all("text_", F.lit(stretch), F.lit(0))).alias("x")).withColumn("h", F.xxhash64("x"))
    sizes, by_hash = F.array(*(F.lit(b * 5 // 4) for b in BANDS)), lambda h, n: F.pmod(h, F.lit(n)).cast("int")
    cased = F.initcap("x")
    forms = F.array(F.regexp_replace(cased, "[^A-Za-z]+", ""), F.regexp_replace(F.lower("x"), "[^a-z]+", ""), F.regexp_replace(cased, "[^A-Za-z]+", "/"))
    form = by_hash(F.col("h"), FORMS)
    d = d.select("h", F.posexplode(forms).alias("form", "joined")) if every else d.select("h", form.alias("form"), F.get(forms, form).alias("joined"))
    d = d.withColumn("n", F.length("joined").cast("long"))
    parts = lambda size: F.greatest(F.lit(1), F.floor(F.col("n") / size).cast("int"))
    counts = F.array_distinct(F.transform(sizes, parts)) if every else F.array(parts(F.get(sizes, by_hash(F.floor(F.col("h") / FORMS), len(BANDS)))))
    d = d.select("h", "form", "joined", "n", F.explode(counts).alias("parts"))
    border = lambda i: F.floor(i * F.col("n") / F.col("parts")).cast("int")
    part = lambda i: F.concat(F.substring("joined", border(i) + 1, border(i + 1) - border(i)), F.pmod(F.shiftrightunsigned("h", 6) + i * 7, F.lit(2000)))
    return d.select("form", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), part)).alias("found"))


def step_of(score: Column) -> Column:
    """Which step of the histogram a score is in."""
    return F.least(F.lit(STEPS - 1), F.floor(score * PER_POINT).cast("int"))


def band_of(found: Column) -> Column:
    n = F.length(found)
    return sum((n >= b).cast("int") for b in BANDS)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """The battery as one method is too large for the JVM to compile; step by step it takes half the time."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def histogram(scored: DataFrame, group: Column | None = None) -> dict[int, dict[int, int]]:
    """Counts by band (or another group) and step: a fixed number of rows at most reaches the driver, however many strings there are."""
    out: dict[int, dict[int, int]] = {}
    group = band_of(F.col("found")) if group is None else group
    # Strings without a score are one more group: a filter on the score would be worked out before it, from copies of its steps.
    for r in scored.groupBy(F.when(F.col("score").isNotNull(), group).alias("band"), step_of(F.col("score")).alias("step")).count().collect():
        if r["band"] is not None:
            out.setdefault(r["band"], {})[r["step"]] = r["count"]
    return out


def reported_upto(tested: dict[int, dict[int, int]], structured: dict[int, dict[int, float]], rate: float) -> dict[int, int]:
    """For each band the greatest step whose candidates are reported, by Benjamini and Hochberg's rule on the shares of
    structured strings with scores as low."""
    out = {}
    for band, counts in tested.items():
        null = structured.get(band, {})
        m, of, seen, low = sum(counts.values()), sum(null.values()) + 1, 0, 1
        for step in range(STEPS):
            seen, low = seen + counts.get(step, 0), low + null.get(step, 0)
            if counts.get(step) and low / of <= rate * seen / m:
                out[band] = step
    return out


def by_band(values: dict[int, int], other: int = -1) -> Column:
    out = F.lit(other)
    for b, value in values.items():
        out = F.when(band_of(F.col("found")) == b, F.lit(value)).otherwise(out)
    return out


def of_any_form(by_form: list[dict[int, int]]) -> dict[int, float]:
    """One histogram of a band out of those of its forms: up to each step the greatest share that a form has there, times the
    number of all strings. So the rule holds whichever form the structured text among the candidates has."""
    sizes = [sum(counts.values()) for counts in by_form]
    below, share, out = [0] * len(by_form), 0.0, {}
    for step in sorted({step for counts in by_form for step in counts}):
        below = [n + counts.get(step, 0) for n, counts in zip(below, by_form)]
        before, share = share, max(n / size for n, size in zip(below, sizes) if size)
        out[step] = (share - before) * sum(sizes)
    return out


def structured_counts(texts: DataFrame, tested: dict[int, dict[int, int]], rate: float) -> dict[int, dict[int, float]]:
    """The histogram of all structured strings of the bands that have candidates: exact up to every step that can be reported.

    Steps are told apart up to a bound first. Where too many strings lie below the bound for any later candidate to be
    reported, it is enough; the other bands are measured again up to their last candidate.
    """
    out: dict[int, dict[int, float]] = {}
    bounds = {b: min(max(counts), FIRST_STEPS) for b, counts in tested.items()}
    while bounds:
        strings = name_strings(texts.sparkSession).unionByName(text_strings(texts, every=True))
        scored = with_battery(strings.where(band_of(F.col("found")).isin(list(bounds))), by_band(bounds))
        with small_methods(texts.sparkSession):
            found = histogram(scored, band_of(F.col("found")) * FORMS + F.col("form"))
        out |= {b: of_any_form([found.get(b * FORMS + form, {}) for form in range(FORMS)]) for b in bounds}
        bounds = {b: max(tested[b]) for b, bound in bounds.items() if bound < max(tested[b]) and undecided(tested[b], out[b], bound, rate)}
    return out


def undecided(counts: dict[int, int], null: dict[int, float], bound: int, rate: float) -> bool:
    """Whether a candidate beyond the bound may be reported, by what is known of the structured strings up to it."""
    m, of = sum(counts.values()), sum(null.values()) + 1
    low = 1 + sum(n for step, n in null.items() if step <= bound)
    return any(step > bound and low / of <= rate * sum(n for s, n in counts.items() if s <= step) / m for step in counts)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """The kept columns and ``spans``: array of (start, kind, end), kind 1 to 4 as in KINDS, sorted by start and kind.

    Null and empty texts have no spans. Repeated rows are scanned as often as they occur; an empty table gives no rows. No
    shuffle but for the counts of the false-discovery control and to bring random spans back to their texts; only spans
    are kept in the checkpoint. At most ``rate`` of the random spans of each band are structured text, by the strings that
    the corpus and the list of names give.
    """
    keep = [id_col] if keep is None else keep
    d = docs.select(*keep, F.monotonically_increasing_id().alias("row_"), whole_text(text_col).alias("text_"))
    for name, pattern in (("m1_", ASSIGN), ("m2_", ACCESS), ("m3_", HEX), ("m4_", CANDIDATE)):
        d = with_spans(d, name, pattern)
    assign = F.filter("m1_", lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 1)) >= 6)
    kinds = [assign, F.col("m2_"), F.col("m3_")]
    as_span = lambda kind: lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    base = F.concat(*(F.transform(k, as_span(i + 1)) for i, k in enumerate(kinds)))
    worth = lambda m: m["found"].rlike("[0-9]") & m["found"].rlike("[A-Za-z]")  # noqa: E731  no inferred encoding otherwise
    free = lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    d = d.select(*keep, "row_", base.alias("base"), F.filter("m4_", worth).alias("cand"))
    d = materialise(d.select(*keep, "row_", "base", F.filter("cand", free).alias("cand")))
    # A checkpoint also keeps the optimiser from copying the battery's steps into every filter on the score.
    tested = materialise(with_battery(d.select("row_", F.explode("cand").alias("m")).select("row_", "m.*")))
    limits = {}
    if candidates := histogram(tested):
        null = structured_counts(docs.select(whole_text(text_col).alias("text_")), candidates, rate)
        limits = reported_upto(candidates, null, rate)
    chance = tested.where(step_of(F.col("score")) <= by_band(limits)).select("row_", F.struct(F.col("start"), F.lit(4).alias("kind"), F.col("end")).alias("m"))
    more = chance.groupBy("row_").agg(F.collect_list("m").alias("more"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return d.join(more, "row_", "left").select(*keep, F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda m: F.element_at(F.array(*map(F.lit, KINDS)), m["kind"])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", name(m), m["start"], m["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the pattern kinds' spans) and spans (all kinds') of each row.

    Null and empty texts have no spans; null ids are kept; repeated rows are reported as often as they occur; matches of
    different kinds at one place are all kept. Further columns are not read. An empty table gives no rows.
    """
    found = scan(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("spans", lambda m: m["kind"] == k)).cast("long").alias(f"n_{KINDS[k - 1]}")
    base = F.filter("spans", lambda m: m["kind"] < 4)
    return found.select(F.col(id_col).alias("doc_id"), count(1), count(2), count(3), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with all their columns; every span of a secret in the text is replaced by a placeholder.

    Overlapping spans become one placeholder. Null texts stay null. Rows equal in id and text get the same result; rows are
    known by two hashes of both, 128 bits together. An empty table gives no rows.
    """
    names, keys = docs.columns, ["__row", "__more"]
    key = [F.xxhash64(F.col(id_col), F.col(text_col)).alias(keys[0]), F.xxhash64(F.lit("more"), F.col(text_col), F.col(id_col)).alias(keys[1])]
    spans = scan(docs.select(*key, F.col(text_col).alias("text")), "__row", "text", keys).where(F.size("spans") > 0).dropDuplicates(keys)
    text = F.col("doc").getField(text_col)

    def paste(acc: Column, m: Column) -> Column:
        fresh = m["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), F.lit(PLACEHOLDER))
        return F.struct(F.greatest(acc["at"], m["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, paste, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    both = docs.select(F.struct(*names).alias("doc"), *key).join(spans, keys, "left")
    both = both.withColumn("text_", F.when(F.col("spans").isNull(), text).otherwise(done))
    return both.select(*(F.col("text_").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in names))
