"""Text forms of values: tuples, escaped fields, plain decimal numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tuple(items: Column) -> Column:
    """``()``, ``(a,)`` or ``(a, b)`` of an array of strings."""
    return F.when(F.size(items) == 1, F.concat(F.lit("("), F.element_at(items, 1), F.lit(",)"))).otherwise(F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")")))


def int_tuple(values: Column) -> Column:
    return _tuple(F.transform(values, lambda v: v.cast("string")))


def span_tuple(spans: Column) -> Column:
    """``((s, e),)`` of an array of structs with start and end."""
    return _tuple(F.transform(spans, lambda s: F.concat(F.lit("("), s["start"].cast("string"), F.lit(", "), s["end"].cast("string"), F.lit(")"))))


def full_tuple(junctions: Column) -> Column:
    """``(('chr', s, e, '+'),)`` of an array of structs with contig, start, end, strand."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return _tuple(F.transform(junctions, lambda j: F.concat(F.lit("("), quoted(j["contig"]), F.lit(", "), j["start"].cast("string"), F.lit(", "), j["end"].cast("string"), F.lit(", "), quoted(j["strand"]), F.lit(")"))))


def word_tuple(words: Column) -> Column:
    return _tuple(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))))


def parse_int_tuple(text: Column) -> Column:
    """The numbers of ``(a, b)``; what isn't a number is dropped."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[()\\s]", ""), ",")
    return F.filter(F.transform(parts, lambda p: F.when(p.rlike("^[+-]?[0-9]+$"), p.try_cast("bigint"))), lambda v: v.isNotNull())


def escape(text: Column) -> Column:
    """Backslash first, then line feed, carriage return and tab, each as a backslash and a letter."""
    shown = text
    for plain, letter in (("\\", "\\"), ("\n", "n"), ("\r", "r"), ("\t", "t")):
        shown = F.replace(shown, F.lit(plain), F.lit("\\" + letter))
    return F.when(text.rlike("[\\\\\n\r\t]"), shown).otherwise(text)


@F.pandas_udf(T.StringType())
def plain_number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Shortest decimals that read back the same, never with an exponent, ``.0`` on whole numbers."""
    import math

    import numpy as np
    import pandas as pd

    def show(x) -> str:
        if x is None or math.isnan(x):
            return "NaN"
        return ("inf" if x > 0 else "-inf") if math.isinf(x) else np.format_float_positional(x, trim="0")

    for values in batches:
        yield pd.Series([show(x) for x in values], dtype=object)
