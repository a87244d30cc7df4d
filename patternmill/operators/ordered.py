"""Values carried from record to record, without one task that sees all records.

A running aggregate over the input's order is computed inside each chunk by a window, and
the chunks' own aggregates, one small row each, are carried over by a second window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import CHUNK, POS

#: How chunks' results are combined, and with what a record's own is.
_COMBINE = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def carried(df: DataFrame, columns: dict[str, tuple[str, Column]], keys: list[Column] | None = None) -> DataFrame:
    """df with a column for each name: the aggregate (sum, max, min or last non-null) over earlier records.

    With keys the order runs inside each key, and a key's records are cut into chunks like all
    records are without, so that a frequent key is no single task. df has __chunk and __pos.
    """
    own_keys = {f"__k{i}": F.coalesce(k.cast("string"), F.lit("\0")) for i, k in enumerate(keys or [])}
    keyed = df.withColumns(own_keys) if own_keys else df
    by = [*own_keys, CHUNK]
    inside = Window.partitionBy(*by).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    across = (Window.partitionBy(*own_keys) if own_keys else Window).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    def own(how: str, c: Column) -> Column:
        return F.max_by(c, F.when(c.isNotNull(), F.col(POS))) if how == "last" else _COMBINE[how][0](c)

    totals = keyed.groupBy(*by).agg(*[own(how, c).alias(f"__t_{n}") for n, (how, c) in columns.items()])
    ahead = totals.select(*by, *[_COMBINE[how][0](F.col(f"__t_{n}")).over(across).alias(f"__a_{n}") for n, (how, _) in columns.items()])
    out = keyed.select("*", *[_COMBINE[how][0](c).over(inside).alias(f"__i_{n}") for n, (how, c) in columns.items()]).join(ahead, by)
    made = [_COMBINE[how][1](F.col(f"__a_{n}"), F.col(f"__i_{n}")).alias(n) for n, (how, _) in columns.items()]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *made)


def in_range(df: DataFrame, start: Column, stop: Column, name: str) -> DataFrame:
    """df with a boolean column: whether a record lies in a range pattern.

    The state before a record is a composition of set, reset and toggle: a record that starts
    only sets it, one that stops only resets it, one that does both toggles it (a range that
    is closed opens, an open one closes). So the state is the last value set, brought forward
    by the parity of the toggles since.
    """
    s, e = F.coalesce(start, F.lit(False)), F.coalesce(stop, F.lit(False))
    df = df.withColumn("__s", s).withColumn("__e", e)
    df = carried(df, {"__t": ("sum", (F.col("__s") & F.col("__e")).cast("long"))})
    parity = F.pmod(F.coalesce(F.col("__t"), F.lit(0)), F.lit(2))
    fixed = F.when(F.col("__s") != F.col("__e"), (F.col("__s").cast("int") + parity) % 2)
    df = df.withColumn("__f", fixed)
    df = carried(df, {"__b": ("last", F.col("__f"))})
    before = (F.coalesce(F.col("__b"), F.lit(0)) + F.pmod(F.coalesce(F.col("__t"), F.lit(0)), F.lit(2))) % 2 == 1
    return df.withColumn(name, before | F.col("__s")).drop("__s", "__e", "__t", "__f", "__b")
