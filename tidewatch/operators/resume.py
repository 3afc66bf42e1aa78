"""Detection that goes on from a saved state: a new day costs a day, whatever the history.

``Fold`` reads a symbol's bars one by one.  What it keeps is bounded by what is still open: the last returns, the highest
close so far and the lowest since, the queue of lows of the rally window, the rally span that may still grow, the legs
of clusters that aren't closed, and the days from the earliest of these on.  A closed cluster leaves the state when it is
told, as later bars start no leg that could join it.

The same fold runs over tables (``resume``: saved states and new bars of all symbols meet in one grouping by symbol) and
in the state store of a stream (``streaming.keyed``).  Together, the episodes told closed at each step and those open
at the last equal events.detect over all bars, to rounding.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import SETTINGS, Settings

_LONG, _DOUBLE, _STRING, _DATE = T.LongType(), T.DoubleType(), T.StringType(), T.DateType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_AT = _struct(close=_DOUBLE, pos=_LONG)
_LEG = _struct(kind=_STRING, start_pos=_LONG, end_pos=_LONG, move=_DOUBLE, recovery_pos=_LONG, reach_pos=_LONG)
#: What is kept of a symbol; days apart, as they are many and rarely read.
STATE = _struct(
    n=_LONG, last=_DATE, prev=_DOUBLE, returns=T.ArrayType(_DOUBLE), top=_AT, low=_AT, lows=T.ArrayType(_AT), recent=T.ArrayType(_AT),
    span=_struct(s=_LONG, e=_LONG, low=_AT, high=_AT), waiting=T.ArrayType(_AT), legs=T.ArrayType(_LEG),
)
DAY = _struct(date=_DATE, close=_DOUBLE, ret=_DOUBLE, z=_DOUBLE)
EPISODE = _struct(
    episode_id=_STRING, start_date=_DATE, end_date=_DATE, anchor_date=_DATE, direction=_STRING, trigger=_STRING, triggers=_STRING, move_pct=_DOUBLE, max_z=_DOUBLE, severity=_DOUBLE,
    search_from=_DATE, search_to=_DATE, recovery_date=_DATE, status=_STRING, detector_version=T.IntegerType(),
)


def _sd(values: list[float]) -> float:
    """Sample deviation, one value after the other as Spark's aggregate takes them."""
    n, mean, m2 = 0, 0.0, 0.0
    for x in values:
        n += 1
        delta = x - mean
        mean += delta / n
        m2 += delta * (x - mean)
    return math.sqrt(m2 / (n - 1)) if n > 1 else math.nan


class Fold:
    """The state of one symbol.  days: position -> (date, close, ret, z), a dict or what acts like one."""

    def __init__(self, settings: Settings = SETTINGS, state: dict | None = None, days=None):
        s = state or {}
        at = lambda x: None if x is None else (x["close"], x["pos"])
        self.settings, self.days = settings, {} if days is None else days
        self.n, self.last, self.prev, self.returns = s.get("n", 0), s.get("last"), s.get("prev"), list(s.get("returns") or [])
        self.top, self.low = at(s.get("top")), at(s.get("low"))
        self.lows, self.recent, self.waiting = ([at(x) for x in s.get(k) or []] for k in ("lows", "recent", "waiting"))
        span = s.get("span")
        self.span = None if span is None else [span["s"], span["e"], at(span["low"]), at(span["high"])]
        self.legs = [tuple(x[k] for k in ("kind", "start_pos", "end_pos", "move", "recovery_pos", "reach_pos")) for x in s.get("legs") or []]

    def state(self) -> dict:
        at = lambda x: None if x is None else {"close": x[0], "pos": x[1]}
        span = None if self.span is None else {"s": self.span[0], "e": self.span[1], "low": at(self.span[2]), "high": at(self.span[3])}
        legs = [dict(zip(("kind", "start_pos", "end_pos", "move", "recovery_pos", "reach_pos"), x)) for x in self.legs]
        many = {k: [at(x) for x in getattr(self, k)] for k in ("lows", "recent", "waiting")}
        return {"n": self.n, "last": self.last, "prev": self.prev, "returns": self.returns, "top": at(self.top), "low": at(self.low), "span": span, "legs": legs, **many}

    def add(self, date: datetime.date, open_: float, close: float) -> None:
        """The next bar."""
        s, pos, here = self.settings, self.n, (close, self.n)
        ret = math.log(close / self.prev) if self.prev is not None and self.prev > 0 and close > 0 else None
        z = self._z(ret)
        gap = open_ / self.prev - 1 if self.prev is not None and self.prev > 0 else None
        if z is not None and abs(z) > s.z_threshold:
            self.legs.append(("shock", pos, pos, ret, None, None))
        if gap is not None and abs(gap) > s.gap_threshold:
            self.legs.append(("gap", pos, pos, ret, None, None))
        if self.top is None or close >= self.top[0]:
            self.legs += self._drawdown(pos)
            self.top = self.low = here
        elif close < self.low[0]:
            self.low = here
        self._rally(here)
        self.days[pos] = (date, close, ret, z)
        self.returns = [*self.returns, ret][-s.sigma_window :]
        self.n, self.prev, self.last = pos + 1, close, date

    def _z(self, ret: float | None) -> float | None:
        known = [x for x in self.returns if x is not None]
        if ret is None or len(known) < self.settings.sigma_window:
            return None
        sd = _sd(known)
        return ret / sd if sd > 0 else math.copysign(math.inf, ret) if sd == 0 and ret else None

    def _drawdown(self, recovery: int | None) -> list[tuple]:
        """The leg from the top, if it is deep enough."""
        if self.top is None or not self.low[0] < self.top[0] or not self.top[0]:
            return []
        depth = self.low[0] / self.top[0] - 1
        return [("drawdown", self.top[1], self.low[1], depth, recovery, None)] if depth <= -self.settings.drawdown_threshold else []

    def _rally(self, here: tuple[float, int]) -> None:
        s, (close, pos) = self.settings, here
        while self.lows and self.lows[-1][0] > close:
            self.lows.pop()
        self.lows.append(here)
        if self.lows[0][1] < pos - s.rally_window:
            self.lows.pop(0)
        self.recent = [*self.recent, here][-(s.rally_window + 1) :]
        low = self.lows[0]
        if self.span is not None:
            self.waiting.append(here)
        if low[0] > 0 and close / low[0] - 1 >= s.rally_threshold:
            if self.span is not None and low[1] <= self.span[1]:
                for x in self.waiting:
                    if x[0] < self.span[2][0]:
                        self.span[2] = self.span[3] = x
                    elif x[0] > self.span[3][0]:
                        self.span[3] = x
                self.span[1] = pos
            else:
                self.legs += self._grown()
                self.span = [low[1], pos, low, max((x for x in self.recent if x[1] >= low[1]), key=lambda x: (x[0], -x[1]))]
            self.waiting = []
        elif self.span is not None and pos + 1 - s.rally_window > self.span[1]:  # no later low reaches back into it
            self.legs += self._grown()
            self.span, self.waiting = None, []

    def _grown(self) -> list[tuple]:
        """The leg of the span."""
        if self.span is None:
            return []
        _, e, low, high = self.span
        return [("rally", low[1], high[1], high[0] / low[0] - 1, None, e)]

    def frontier(self) -> int:
        """The first position that later bars may still touch."""
        if not self.n:
            return 0
        return min(self.n - self.settings.rally_window, self.top[1] if self.prev < self.top[0] else self.n, self.n)

    def clusters(self) -> list[tuple[bool, list[tuple]]]:
        """Whether it is closed, and its legs, of every cluster that is kept; what is open counts as it stands."""
        s, edge, out, end = self.settings, self.frontier(), [], None
        for leg in sorted([*self.legs, *self._drawdown(None), *self._grown()], key=lambda x: (x[1], x[2], x[0])):
            if end is None or leg[1] > end + s.merge_window:
                out.append([])
            end = leg[2] if end is None else max(end, leg[2])
            out[-1].append(leg)
        reach = lambda legs: max(x[2] if x[5] is None else x[5] for x in legs)
        unrecovered = lambda legs: any(x[0] == "drawdown" and x[4] is None for x in legs)
        return [(reach(legs) + s.merge_window < edge and not unrecovered(legs), legs) for legs in out]

    def close(self) -> list[dict]:
        """The episodes that have closed since the last call.  Their legs, and days that nothing open needs, are let go."""
        s, parts = self.settings, self.clusters()
        told = [self.episode(legs, True) for closed, legs in parts if closed]
        gone = {leg for closed, legs in parts if closed for leg in legs}
        self.legs = [x for x in self.legs if x not in gone]
        starts = [legs[0][1] for closed, legs in parts if not closed]
        first = min([self.frontier(), *starts, *([self.span[0]] if self.span else [])]) - max(s.search_pre, s.search_half_width, 1)
        for pos in [p for p in self.days if p < first]:
            del self.days[pos]
        return told

    def open(self) -> list[dict]:
        """The episodes that later bars may still change."""
        return [self.episode(legs, False) for closed, legs in self.clusters() if not closed]

    def episode(self, legs: list[tuple], closed: bool) -> dict:
        s = self.settings
        start, end = min(x[1] for x in legs), max(x[2] for x in legs)
        kinds = {x[0] for x in legs}
        trigger = next(k for k in s.precedence if k in kinds)
        days = {p: self.days[p] for p in range(start, end + 1)}
        moved = [(p, d[2]) for p, d in days.items() if d[2] is not None]
        anchor, anchor_ret = min(moved, key=lambda x: (-abs(x[1]), x[0]), default=(None, None))
        sizes = [abs(d[3]) for d in days.values() if d[3] is not None]
        max_z = max(sizes) if any(x < math.inf for x in sizes) else 0.0
        steep = None
        if trigger in ("drawdown", "rally") and moved:
            sign = 1 if trigger == "drawdown" else -1
            steep = min(moved, key=lambda x: (sign * x[1], x[0]))[0]
        of = lambda kind, k: [x[k] for x in legs if x[0] == kind and x[k] is not None]
        if trigger == "drawdown":
            direction, move = "down", min(of("drawdown", 3))
        elif trigger == "rally":
            direction, move = "up", max(of("rally", 3))
        else:
            direction = "down" if anchor_ret is not None and anchor_ret < 0 else "up"
            move = self.days[end][1] / self.days[max(start - 1, 0)][1] - 1
        clamp = lambda p: min(max(p, 0), self.n - 1)
        search = (start - s.search_pre, end + s.search_post) if steep is None else (steep - s.search_half_width, steep + s.search_half_width)
        date = lambda p: None if p is None else self.days[p][0]
        recovered = not any(x[0] == "drawdown" and x[4] is None for x in legs)
        return {
            "episode_id": "_".join([*([date(anchor).isoformat()] if anchor is not None else []), trigger]),
            "start_date": date(start), "end_date": date(end), "anchor_date": date(anchor), "direction": direction, "trigger": trigger, "triggers": ",".join(sorted(kinds)),
            "move_pct": move, "max_z": max_z, "severity": max_z + abs(move) / s.severity_step,
            "search_from": date(clamp(search[0])), "search_to": date(clamp(search[1])),
            "recovery_date": date(max(of("drawdown", 4), default=None)) if recovered else None,
            "status": "closed" if closed else "open", "detector_version": s.detector_version,
        }


def in_order(rows: Iterable, after: datetime.date | None = None) -> Iterator:
    """Bars by date, one for each (of several the one of largest volume, then by its other values); only those after a date."""
    last = after
    for r in sorted(rows, key=lambda r: (r["date"], -(r["volume"] or 0.0), r["open"], r["close"])):
        if last is None or r["date"] > last:
            yield r
            last = r["date"]


BARS = ("symbol", "date", "open", "close", "volume")
SAVED = T.StructType([*STATE.fields, T.StructField("days", T.ArrayType(T.StructType([T.StructField("pos", _LONG), *DAY.fields])))])
RESUMED = _struct(symbol=_STRING, episode=EPISODE, state=SAVED)


def resume(bars: DataFrame, states: DataFrame | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """New bars and saved states (symbol, state) -> symbol, and either episode or state.

    A symbol's episodes are those that closed with these bars, and the ones open after them; its state is the one to save.
    Symbols without new bars tell what they told.  Bars up to a state's last date are passed over.  Write the result
    before taking it apart, as both parts come from one pass.
    """
    spark = bars.sparkSession
    if states is None:
        states = spark.createDataFrame([], T.StructType([RESUMED["symbol"], RESUMED["state"]]))

    def run(key, left, right):
        import pyarrow as pa

        saved = right.column("state").to_pylist()[0] if right.num_rows else None
        days = {d["pos"]: (d["date"], d["close"], d["ret"], d["z"]) for d in (saved or {}).get("days") or []}
        fold = Fold(settings, saved, days)
        for bar in in_order(left.select(["date", "open", "close", "volume"]).to_pylist(), fold.last):
            fold.add(bar["date"], bar["open"], bar["close"])
        symbol = key[0].as_py()
        told = fold.close() + fold.open()
        kept = fold.state() | {"days": [dict(zip(("pos", "date", "close", "ret", "z"), (p, *d))) for p, d in sorted(fold.days.items())]}
        from pyspark.sql.pandas.types import to_arrow_type

        columns = {"symbol": [symbol] * (len(told) + 1), "episode": [*told, None], "state": [None] * len(told) + [kept]}
        return pa.table({f.name: pa.array(columns[f.name], to_arrow_type(f.dataType)) for f in RESUMED})

    new = bars.select(*BARS)
    old = states.select(F.col("symbol").alias("of"), "state")
    return new.groupBy("symbol").cogroup(old.groupBy("of")).applyInArrow(run, RESUMED)


def episodes_of(resumed: DataFrame) -> DataFrame:
    return resumed.filter("episode IS NOT NULL").select("symbol", "episode.*")


def states_of(resumed: DataFrame) -> DataFrame:
    return resumed.filter("state IS NOT NULL").select("symbol", "state")
