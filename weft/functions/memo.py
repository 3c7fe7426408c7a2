"""Column expressions that are built once a session."""

from __future__ import annotations

import functools


def remembered(make):
    """``make``, whose result is kept by its arguments' text.

    Building a large expression takes thousands of calls into the JVM. Arguments must be plain values or columns
    by name (not of a DataFrame, nor a lambda's), so that equal text means equal columns.
    """
    kept: dict = {}

    @functools.wraps(make)
    def run(*args):
        from pyspark import SparkContext

        key = (id(SparkContext._active_spark_context), *map(str, args))
        if key not in kept:
            kept[key] = make(*args)
        return kept[key]

    return run
