"""Running values of long series, in two levels, so that one symbol is many tasks.

A series is cut to blocks of days.  Inside a block the running value starts from nothing; a block's total is one row; the
totals before a block, in the order of blocks, give what goes into it; both are put together by row.  Rows are dealt by
symbol and block, and only the totals of a symbol, one row for some hundred days, meet in one task.

What needs the rows before a row (lags, moving sums) reads them from an overhang: rows are numbered by a running count,
cut to chunks of equal length, and the last rows of a chunk are sent to the next one as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block, and the least rows of a chunk.
BLOCK_DAYS, CHUNK_ROWS = 256, 1024


@dataclass(frozen=True)
class Scan:
    """A running value of a column: sum, count, max, min, product, or ema of a period (null until there are so many)."""

    kind: str
    column: str
    period: int = 0

    def __post_init__(self):
        if self.kind not in (*_KINDS, "ema") or (self.kind == "ema") != (self.period > 1):
            raise ValueError(f"not a running value: {self}")


#: kind -> aggregate, and how what goes in and what is inside make the value; nulls are no values.
_KINDS: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "product": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))),
}


def _composed(beta: float, field: str) -> Callable:
    """What goes into a block -> what comes out, by the block's map."""
    return lambda acc, m: F.pow(F.lit(beta), m["n"]) * acc + m[field]


def _averaged(beta: float) -> Callable:
    return lambda acc, r: F.lit(beta) * acc + F.lit(1 - beta) * r["x"]


def running(df: DataFrame, scans: dict[str, Scan], by: tuple[str, ...] = ("symbol",), order: str = "date") -> DataFrame:
    """df with a column for each scan: its value over the rows of by up to each row's day; one row a day."""
    d = df.withColumn("_block", F.floor(F.unix_date(order) / BLOCK_DAYS))
    so_far = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside, totals, brought, out = {}, {}, {}, {}
    for name, s in scans.items():
        x = F.col(s.column)
        if s.kind != "ema":
            aggregate, put = _KINDS[s.kind]
            again = F.sum if s.kind == "count" else aggregate
            inside[f"_i_{name}"] = aggregate(x).over(so_far)
            totals[f"_t_{name}"] = aggregate(x)
            brought[f"_b_{name}"] = again(f"_t_{name}").over(before)
            out[name] = put(F.col(f"_b_{name}"), F.col(f"_i_{name}"))
            continue
        # a block maps what goes in to beta^n times that, and the average of its own values from 0 on
        beta, known = 1 - 2.0 / (s.period + 1), F.count(x).over(so_far)
        inside[f"_n_{name}"] = known
        inside[f"_i_{name}"] = F.lit(1 - beta) * F.pow(F.lit(beta), known) * F.sum(x * F.pow(F.lit(beta), -known)).over(so_far)
        totals[f"_t_{name}"] = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order, x.cast("double").alias("x")))))
        brought[f"_m_{name}"] = F.sum(F.size(f"_t_{name}")).over(before)
        maps = F.collect_list(F.struct(F.size(f"_t_{name}").alias("n"), f"_w_{name}")).over(before)
        first = F.min_by(F.get(f"_t_{name}", F.lit(0))["x"], F.when(F.size(f"_t_{name}") > 0, F.col("_block"))).over(Window.partitionBy(*by))
        brought[f"_b_{name}"] = F.aggregate(maps, first, _composed(beta, f"_w_{name}"))
        many = F.coalesce(f"_m_{name}", F.lit(0)) + F.col(f"_n_{name}")
        out[name] = F.when(many >= s.period, F.coalesce(f"_i_{name}", F.lit(0.0)) + F.pow(F.lit(beta), F.col(f"_n_{name}")) * F.col(f"_b_{name}"))
    sums = d.groupBy(*by, "_block").agg(*[c.alias(k) for k, c in totals.items()])
    for name, s in scans.items():
        if s.kind == "ema":
            beta = 1 - 2.0 / (s.period + 1)
            sums = sums.withColumn(f"_w_{name}", F.aggregate(f"_t_{name}", F.lit(0.0), _averaged(beta)))
    # dealt by block again, or the join would bring all rows of a symbol to where its totals are
    sums = sums.withColumns(brought).select(*by, "_block", *brought).repartition(*by, "_block")
    return d.withColumns(inside).join(sums, [*by, "_block"]).withColumns(out).select(*df.columns, *scans)


def in_chunks(df: DataFrame, reach: int, then: Callable[[DataFrame], DataFrame], by: str = "symbol", order: str = "date") -> DataFrame:
    """then(rows) over chunks of a series, each with the reach rows before it; then sees by as the chunk's key, and may add columns only.

    What then computes from a row and the reach rows before it is what it would be over the whole series.
    """
    size = max(CHUNK_ROWS, 4 * reach)
    d = running(df.withColumn("_one", F.lit(1)), {"_n": Scan("count", "_one")}, (by,), order).drop("_one")
    at = F.floor((F.col("_n") - 1) / size)
    over = (F.col("_n") - 1) % size >= size - reach
    d = d.withColumn("_own", at).withColumn("_chunk", F.explode(F.when(over, F.array(at, at + 1)).otherwise(F.array(at))))
    keyed = d.withColumn("_of", F.col(by)).withColumn(by, F.struct(F.col(by).alias("of"), F.col("_chunk").alias("chunk")))
    out = then(keyed).filter(F.col("_chunk") == F.col("_own"))
    return out.withColumn(by, F.col("_of")).drop("_of", "_own", "_chunk", "_n")


def lagged(df: DataFrame, columns: dict[str, Column], reach: int, by: str = "symbol", order: str = "date") -> DataFrame:
    """df with columns computed from windows of at most reach rows before a row (see in_chunks)."""
    return in_chunks(df, reach, lambda d: d.withColumns(columns), by, order)
