"""The functions on reads by name, for queries written in SQL alone.

``register(spark)`` adds them to a session. Those of one expression are SQL functions, which the optimiser puts in place of
their calls; those that compare places along reads work on Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import transform

#: name: (parameters, result, body). Later ones call earlier ones.
EXPRESSIONS = {
    "read_id": ("h string", "string", "regexp_extract(h, '^[^ \\t]*', 0)"),
    "norm_id": ("h string", "string", "regexp_replace(read_id(h), '/[12]$', '')"),
    "second_token": ("h string", "string", "regexp_extract(h, '^[^ \\t]*[ \\t]+([^ \\t]+)', 1)"),
    "says_mate": ("h string, k string", "boolean", "endswith(read_id(h), concat('/', k)) or startswith(second_token(h), concat(k, ':')) or endswith(second_token(h), concat('/', k))"),
    "mate_marks": ("h string", "int", "if(says_mate(h, '1'), 1, 0) + if(says_mate(h, '2'), 2, 0)"),
    "names_match": ("a string, b string", "boolean", "norm_id(a) = norm_id(b) and norm_id(a) <> '' and (mate_marks(a) = 0 and mate_marks(b) = 0 or mate_marks(a) = 1 and mate_marks(b) = 2)"),
    "revcomp": ("s string", "string", "reverse(translate(regexp_replace(upper(s), '[^ACGT]', 'N'), 'ACGT', 'TGCA'))"),
    "count_letters": ("s string, which string", "int", "length(s) - length(translate(s, which, ''))"),
    "gc_fraction": ("s string", "double", "count_letters(upper(s), 'GC') / nullif(count_letters(upper(s), 'ACGT'), 0)"),
}


@F.pandas_udf(T.LongType())
def tail_kept(seq: pd.Series, qual: pd.Series, window: pd.Series, quality: pd.Series) -> pd.Series:
    """Bases kept by the quality tail; window and quality may differ from read to read. Null reads count as empty."""
    kept = pd.Series(0, index=seq.index, dtype="int64")
    for (w, q), rows in pd.DataFrame({"w": window, "q": quality}).groupby(["w", "q"]).groups.items():
        found = transform.by_groups([list(seq[rows]), list(qual[rows])], lambda a, b: {"kept": transform.tail_kept(a, b, int(w), int(q))})  # noqa: B023
        kept[rows] = found["kept"]
    return kept


#: Functions on Arrow batches: mate_overlap gives a struct of offset and length, null where mates don't overlap.
BATCHES = {"tail_kept": tail_kept, "mate_overlap": transform.mate_overlap}


def register(spark: SparkSession) -> list[str]:
    """Adds all functions to the session as temporary ones, and returns their names."""
    for name, (parameters, result, body) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    for name, function in BATCHES.items():
        spark.udf.register(name, function)
    return [*EXPRESSIONS, *BATCHES]
