"""Running values over ordered groups of any size.

A plain window puts a whole group into one task.  Here a group is cut into chunks along its
order; chunks are windowed side by side, and what a chunk must know of the ones before it is
one small row.  Only those small rows are windowed by the full group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CHUNK = "_chunk"


def _as_cols(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    chunk: Column | None = None,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    befores: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns to ``df``.

    sums     running sum, this row included
    lasts    last non-null value, this row included
    befores  last non-null value strictly before this row

    ``df`` is read twice, so give it a table and not a costly plan.

    ``chunk`` must not decrease along ``order`` within a group and must hold a bounded number
    of rows.  Without it the rows are range-partitioned by keys and order, and a chunk is a
    range.
    """
    sums, lasts, befores = sums or {}, lasts or {}, befores or {}
    work = {f"_s_{n}": c for n, c in sums.items()}
    work |= {f"_l_{n}": c for n, c in lasts.items()}
    work |= {f"_b_{n}": c for n, c in befores.items()}
    staged = df.select("*", *[c.alias(n) for n, c in work.items()])
    if chunk is not None:
        # One shuffle serves the chunk totals, the join and the window.
        staged = staged.withColumn(CHUNK, chunk).repartition(*_as_cols([*keys, CHUNK]))
    else:
        ranged = staged.repartitionByRange(*_as_cols([*keys, *order]))
        staged = cut(ranged.withColumn(CHUNK, F.spark_partition_id()))

    position = F.struct(*_as_cols(order))
    totals = staged.groupBy(*keys, CHUNK).agg(
        *[F.sum(f"_s_{n}").alias(f"_ct_s_{n}") for n in sums],
        *[_last_in(f"_l_{n}", position).alias(f"_ct_l_{n}") for n in lasts],
        *[_last_in(f"_b_{n}", position).alias(f"_ct_b_{n}") for n in befores],
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys, CHUNK,
        *[F.sum(f"_ct_s_{n}").over(earlier).alias(f"_c_s_{n}") for n in sums],
        *[F.last(f"_ct_l_{n}", True).over(earlier).alias(f"_c_l_{n}") for n in lasts],
        *[F.last(f"_ct_b_{n}", True).over(earlier).alias(f"_c_b_{n}") for n in befores],
    )
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    joined = staged.join(carry, [*keys, CHUNK], "left")
    out = {}
    for n in sums:
        out[n] = F.sum(f"_s_{n}").over(upto) + F.coalesce(F.col(f"_c_s_{n}"), F.lit(0))
    for n in lasts:
        out[n] = F.coalesce(F.last(f"_l_{n}", True).over(upto), F.col(f"_c_l_{n}"))
    for n in befores:
        out[n] = F.coalesce(F.last(f"_b_{n}", True).over(before), F.col(f"_c_b_{n}"))
    columns = [c for c in df.columns if c not in out]
    return joined.select(*columns, *[c.alias(n) for n, c in out.items()])


def _last_in(name: str, position: Column) -> Column:
    return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), position))


def first_by(value: Column, position: Column) -> Column:
    """The first non-null ``value`` along ``position``; order-safe, unlike ``first``."""
    return F.min_by(value, F.when(value.isNotNull(), position))


def joined_text(text: str, position: list[str], sep: str) -> Column:
    """Aggregate: texts joined in order.  For groups bounded by one page or one chunk."""
    rows = F.array_sort(F.collect_list(F.struct(*_as_cols([*position, text]))))
    return F.array_join(F.transform(rows, lambda r: r[text]), sep)
