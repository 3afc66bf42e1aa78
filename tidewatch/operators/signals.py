"""Rules: target exposure decided at each close; null where there isn't enough history."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import MASpec, add_averages


def crossover(short: Column, long: Column) -> Column:
    """1 while short is above long, else 0 (also if equal); null unless both are known."""
    return (short > long).cast("double")


def both(a: Column, b: Column) -> Column:
    """The smaller of two targets; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


@runtime_checkable
class Strategy(Protocol):
    """Anything with a name, the averages it needs and a target over a frame that has them."""

    name: str

    def needs(self) -> list[MASpec]: ...

    def target(self) -> Column: ...


@dataclass(frozen=True)
class MACrossover:
    """short above long, and with trend the close above its simple average of that period."""

    short: MASpec
    long: MASpec
    trend: int | None = None

    @property
    def name(self) -> str:
        base = f"{self.short.label}__{self.long.label}"
        return base if self.trend is None else f"{base}__trend{self.trend}"

    def needs(self) -> list[MASpec]:
        return [self.short, self.long] + ([MASpec("sma", self.trend)] if self.trend else [])

    @property
    def text(self) -> str:
        """target() as text, so that hundreds of rules cost one call to the JVM; the same as crossover() and both()."""
        t = f"CAST({self.short.label} > {self.long.label} AS DOUBLE)"
        if self.trend is None:
            return t
        up = f"CAST(close > sma{self.trend} AS DOUBLE)"
        return f"CASE WHEN {t} IS NOT NULL AND {up} IS NOT NULL THEN least({t}, {up}) END"

    def target(self) -> Column:
        return F.expr(self.text)


@dataclass(frozen=True)
class TrendFilter:
    """Close above its simple average."""

    period: int = 200

    @property
    def name(self) -> str:
        return f"close__sma{self.period}"

    def needs(self) -> list[MASpec]:
        return [MASpec("sma", self.period)]

    def target(self) -> Column:
        return crossover(F.col("close"), F.col(f"sma{self.period}"))


@dataclass(frozen=True)
class Both:
    """Two rules at once."""

    a: Strategy
    b: Strategy

    @property
    def name(self) -> str:
        return f"{self.a.name}__and__{self.b.name}"

    def needs(self) -> list[MASpec]:
        return self.a.needs() + self.b.needs()

    def target(self) -> Column:
        return both(self.a.target(), self.b.target())


def steady(rule: Strategy) -> bool:
    """Whether the rule's target, once known, stays known on every later bar.  True of rules over averages."""
    if isinstance(rule, Both):
        return steady(rule.a) and steady(rule.b)
    return isinstance(rule, (MACrossover, TrendFilter))


def with_averages(bars: DataFrame, rules: list[Strategy]) -> DataFrame:
    """Bars with each distinct average that the rules need, computed once."""
    if not rules:
        raise ValueError("no rules")
    return add_averages(bars, [s for r in rules for s in r.needs()])


def fan_out(averaged: DataFrame, rules: list[Strategy]) -> DataFrame:
    """symbol, rule, date, open, close, target: every rule at every bar, from the same row and without a join."""
    fan = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), r.target().alias("target")) for r in rules]))
    return averaged.select("symbol", "date", "open", "close", fan.alias("x")).select("symbol", "x.rule", "date", "open", "close", "x.target")


def targets(bars: DataFrame, rules: list[Strategy]) -> DataFrame:
    return fan_out(with_averages(bars, rules), rules)


def crossings(target_frame: DataFrame) -> DataFrame:
    """symbol, rule, date, crossing (1 or -1) where the known target changes; the first never does."""
    w = Window.partitionBy("symbol", "rule").orderBy("date")
    known = target_frame.filter("target IS NOT NULL")
    return known.withColumn("step", F.col("target") - F.lag("target").over(w)).filter("step <> 0").select("symbol", "rule", "date", F.signum("step").cast("int").alias("crossing"))
