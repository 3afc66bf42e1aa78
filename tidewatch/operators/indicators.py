"""Moving averages."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_date():
    """Each symbol's bars in time."""
    return Window.partitionBy("symbol").orderBy("date")


@dataclass(frozen=True, order=True)
class MASpec:
    kind: str
    period: int

    def __post_init__(self):
        if self.kind not in ("sma", "ema") or self.period < 1:
            raise ValueError(f"not a moving average: {self.kind}{self.period}")

    @property
    def label(self) -> str:
        return f"{self.kind}{self.period}"

    @classmethod
    def from_label(cls, label: str) -> MASpec:
        m = re.fullmatch(r"(sma|ema)(\d+)", label)
        if not m:
            raise ValueError(f"not a moving average: {label!r}")
        return cls(m[1], int(m[2]))


def sma(n: int, column: str = "close") -> Column:
    """Mean of the last n; null until there are n."""
    frame = by_date().rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))


#: A block's smallest weight is about exp(-this), at most, so it is a double.
BLOCK_DECAY = 600.0
#: What has decayed to exp(-this) is nothing beside what it is added to.
FORGOTTEN = 40.0


def ema_block(n: int) -> int:
    """Bars of a block in which the weights of an average of n are doubles; a power of two."""
    return 1 << int(math.log2(BLOCK_DECAY / -math.log(1 - 2.0 / (n + 1))))


def add_averages(bars: DataFrame, specs: list[MASpec], column: str = "close") -> DataFrame:
    """A column for each spec: windows by symbol only, whose expressions are text, as one call to the JVM holds them all.

    Simple ones come from one running sum.  It is a decimal of 20 places of the values over a power of two near their symbol's
    first, so the difference of two of its values is the window's sum without the error that doubles would gather,
    however long the series and whatever the size of its prices; each further period costs a lag and no frame of its own.

    Exponential ones are the recursion ema = alpha x + beta ema as blocked composition of affine maps.  Inside a block
    of known values the average from 0 on is a running sum of x / beta^k, times alpha beta^k.  A block as a whole maps
    what goes in to beta^block times that, and its own last value; the last maps before a block are folded to what goes
    into it, and the first value of all goes into the first.  A null keeps the average that stands before it.
    """
    specs = sorted(set(specs))
    x, by = f"CAST(`{column}` AS DOUBLE)", "OVER (PARTITION BY symbol ORDER BY date)"
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = f"OVER (PARTITION BY symbol ORDER BY date {so_far}"
    d = bars.selectExpr("*", f"count({x}) {run} AS _c", f"first({x}, true) {run} AS _first", f"coalesce(pow(2D, floor(log2(abs(first(nullif({x}, 0D), true) {run})))), 1D) AS _unit")
    out = {s: f"last({x}, true) {run}" for s in specs if s.kind == "ema" and s.period == 1}
    emas = [s.period for s in specs if s.kind == "ema" and s.period > 1]
    if emas:
        block, betas = min(map(ema_block, emas)), {n: 1 - 2.0 / (n + 1) for n in emas}
        d = d.selectExpr("*", f"CAST(greatest(_c - 1, 0) % {block} AS INT) AS _k", f"CAST(greatest(_c - 1, 0) div {block} AS INT) AS _b")
        inside = f"OVER (PARTITION BY symbol, _b ORDER BY date {so_far}"
        d = d.selectExpr("*", *[f"{1 - b!r}D * pow({b!r}D, _k) * sum({x} * pow({b!r}D, -_k)) {inside} AS _l{n}" for n, b in betas.items()])
        own = f"array({', '.join(f'_l{n}' for n in emas)})"
        d = d.selectExpr("*", f"collect_list(CASE WHEN _k = {block - 1} AND {x} IS NOT NULL THEN {own} END) {run} AS _ends")
        for i, (n, b) in enumerate(betas.items()):
            many = math.ceil(FORGOTTEN / (block * -math.log(b)))
            before = f"slice(_ends, greatest(_b - {many}, 0) + 1, least(_b, {many}))"
            brought = f"aggregate({before}, _first, (acc, e) -> {b**block!r}D * acc + e[{i}])"
            out[MASpec("ema", n)] = f"CASE WHEN _c >= {n} THEN _l{n} + pow({b!r}D, _k + 1) * {brought} END"
    smas = [s.period for s in specs if s.kind == "sma"]
    if smas:
        d = d.selectExpr("*", f"CAST(coalesce(sum(try_cast({x} / _unit AS DECIMAL(28,20))) {run}, 0) AS DECIMAL(37,20)) AS _sum")
        for n in smas:
            before = f"coalesce(lag(_sum, {n}) {by}, CAST(0 AS DECIMAL(37,20)))"
            out[MASpec("sma", n)] = f"CASE WHEN _c - lag(_c, {n}, 0L) {by} = {n} THEN CAST(_sum - {before} AS DOUBLE) * _unit / {n} END"
    kept = [f"`{c}`" for c in bars.columns]
    return d.selectExpr(*kept, *[f"{out[s]} AS {s.label}" for s in specs])


def ema_fold(n: int, column: str = "close", reach: int = 20) -> Column:
    """The same average as one expression: a fold over the last reach x n bars, whose cut weight is about exp(-2 x reach).

    For bounded frames where no Python should run.
    """
    alpha = 2.0 / (n + 1)
    frame = by_date().rowsBetween(-(reach * n - 1), 0)
    held = F.collect_list(column).over(frame)
    folded = F.aggregate(F.slice(held, 2, reach * n), F.element_at(held, 1), lambda s, x: F.lit(alpha) * x + F.lit(1 - alpha) * s)
    return F.when(F.size(held) >= n, folded)
