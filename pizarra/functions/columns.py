"""Reuse of built Column expressions.

A Column is an immutable, unresolved expression, so one built for a set of
arguments can serve every plan of the same Spark context. Building it costs
several driver-to-JVM calls per function used, which for the JSON documents
(hundreds of rates and conditional counts) is most of their planning time.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


#: Entries a memo keeps; the oldest go first.
KEPT = 256


def per_context(fn):
    """Memoise a Column-building function on its arguments, for the Spark
    context of the last call. Calls with unhashable arguments (Columns) are
    built afresh; a new context empties the memo."""
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        try:
            key = (args, tuple(sorted(kwargs.items())))
            hash(key)
        except TypeError:
            return fn(*args, **kwargs)
        context = SparkContext._active_spark_context
        if cache.get("context") is not context:
            cache.clear()
            cache["context"] = context
        if key not in cache:
            if len(cache) > KEPT:
                del cache[next(k for k in cache if k != "context")]
            cache[key] = fn(*args, **kwargs)
        return cache[key]

    return wrapper
