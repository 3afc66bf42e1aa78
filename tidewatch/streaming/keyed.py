"""Episodes of a stream of bars, told when they close, from state that the store keeps by symbol.

The state of a symbol is a resume.Fold: a value of bounded size that every batch reads and writes, and a map of days by
position, of which a batch adds its own, deletes those that nothing open needs, and reads others only when an episode
closes.  So a batch costs its bars, however long the series is, and closed history leaves the store.

A bar that isn't later than its symbol's last is a repeat or a revision: it changes nothing and is told as a row of status
``refused`` with its date, but for one of the close that is kept.  Bars of a batch may come in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.resume import BARS, DAY, EPISODE, STATE, Fold, in_order
from ..settings import SETTINGS, Settings
from ..sources.bars import drop_incomplete

OUT = T.StructType([T.StructField("symbol", T.StringType()), *EPISODE.fields])
#: The store that keeps state beyond memory, with only what has changed written at each batch.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _plain(x):
    """A row and all in it as dictionaries and lists."""
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    return [_plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def _typed(x, kind: T.DataType):
    """Back to tuples, in the order of the type's fields."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_typed(x[f.name], f.dataType) for f in kind)
    return [_typed(v, kind.elementType) for v in x] if isinstance(kind, T.ArrayType) else x


class _Days(MutableMapping):
    """Days in the state store; what a batch has seen of them is kept at hand, and positions are contiguous."""

    def __init__(self, stored, first: int, end: int):
        self.stored, self.first, self.end, self.seen = stored, first, end, {}

    def __getitem__(self, pos):
        if pos not in self.seen:
            row = self.stored.getValue((pos,))
            if row is None:
                raise KeyError(pos)
            self.seen[pos] = (row[0], row[1], row[2], row[3])
        return self.seen[pos]

    def __setitem__(self, pos, day):
        self.seen[pos] = day
        self.stored.updateValue((pos,), day)
        self.end = pos + 1

    def __delitem__(self, pos):
        self.stored.removeKey((pos,))
        self.seen.pop(pos, None)
        self.first = pos + 1

    def __iter__(self):
        return iter(range(self.first, self.end))

    def __len__(self):
        return self.end - self.first


class Detector(StatefulProcessor):
    """transformWithState by symbol: bars in, closed episodes and refused bars out."""

    def __init__(self, settings: Settings = SETTINGS):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("fold", T.StructType([*STATE.fields, T.StructField("first_day", T.LongType())]))
        self.days = handle.getMapState("days", T.StructType([T.StructField("pos", T.LongType())]), DAY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        saved = dict(zip([*STATE.names, "first_day"], map(_plain, self.kept.get()))) if self.kept.exists() else {}
        days = _Days(self.days, saved.get("first_day", 0), saved.get("n", 0))
        fold = Fold(self.settings, saved, days)
        bars = [r.asDict() for r in rows]
        old = [b for b in bars if fold.last is not None and b["date"] <= fold.last]
        for bar in in_order(bars, fold.last):
            fold.add(bar["date"], bar["open"], bar["close"])
        known = {days[p][0]: days[p][1] for p in days} if old else {}
        out = Row(*OUT.fieldNames())
        for bar in sorted(old, key=lambda b: b["date"]):
            if known.get(bar["date"]) != bar["close"]:
                yield out(key[0], None, bar["date"], *[None] * 11, "refused", self.settings.detector_version)
        for e in fold.close():
            yield out(key[0], *[e[f.name] for f in EPISODE])
        self.kept.update((*_typed(fold.state(), STATE), days.first))

    def close(self) -> None:
        pass


def closed_episodes(bars: DataFrame, settings: Settings = SETTINGS, now: Callable[[], str] | None = None) -> DataFrame:
    """A stream of bars -> symbol and the columns of an episode, each told once, when nothing later can change it.

    now, if given, tells the UTC time at which the stream is set up; a session that isn't over then is left for later.
    """
    if now is not None:
        bars = drop_incomplete(bars, now(), settings.session_complete_after)
    return bars.select(*BARS).groupBy("symbol").transformWithState(statefulProcessor=Detector(settings), outputStructType=OUT, outputMode="Append", timeMode="None")


def run_available(spark: SparkSession, bars: DataFrame, out: str, checkpoint: str, settings: Settings = SETTINGS) -> DataFrame:
    """Process what the source of a stream of bars holds, and return every row told so far."""
    for k, v in STORE.items():
        spark.conf.set(k, v)
    q = closed_episodes(bars, settings).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(OUT).parquet(out)
