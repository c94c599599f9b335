"""Column helpers for the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where lambdas in it use the value often."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast way to the same text."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def starts(count: Column, size) -> Column:
    """0 .. count - size as an array, empty where nothing fits."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(count >= size, F.sequence(F.lit(0), (count - size).cast("int"))).otherwise(F.array().cast("array<int>"))


def covered(spans: Column) -> Column:
    """Places covered by an array of (lo, hi) structs with hi exclusive, overlaps counted once."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda a, x: F.struct(
            (a["sum"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], a["reach"]))).alias("sum"),
            F.greatest(a["reach"], x["hi"]).alias("reach"),
        ),
        lambda a: a["sum"],
    )
