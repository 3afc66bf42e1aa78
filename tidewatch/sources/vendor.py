"""Daily bars from outside: a Python data source over any fetch function, as table or stream, and calls that may be tried again."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COLUMNS = "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double"


def with_retry(call: Callable, attempts: int = 4, wait: float = 2.0, most: float = 30.0, sleep: Callable = time.sleep, on: tuple[type[Exception], ...] = (Exception,)):
    """call's result; after each failure of the sorts in on, but the last, a wait that doubles up to most."""
    for k in range(attempts):
        try:
            return call()
        except on:
            if k + 1 == attempts:
                raise
            sleep(min(most, wait * 2**k))


@dataclass
class Span(InputPartition):
    """Days of one symbol, both ends included; an end may be open."""

    symbol: str
    start: str | None
    end: str | None


#: Days of a span that one call fetches.
SPAN_DAYS = 3660


def spans(symbol: str, start: str | None, end: str | None, days: int = SPAN_DAYS) -> list[Span]:
    """start..end of a symbol in spans of days at most; one span if an end is open, none if no day is left."""
    if start is None or end is None:
        return [Span(symbol, start, end)]
    a, last, out = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end), []
    while a <= last:
        b = min(last, a + datetime.timedelta(days=days - 1))
        out.append(Span(symbol, a.isoformat(), b.isoformat()))
        a = b + datetime.timedelta(days=1)
    return out


class _Fetching:
    def __init__(self, options: dict, fetch: Callable):
        self.symbols = [s.strip() for s in options["symbols"].split(",") if s.strip()]
        self.start, self.end, self.fetch = options.get("start"), options.get("end"), fetch

    def rows(self, span: Span, must: bool):
        rows = with_retry(lambda: list(self.fetch(span.symbol, span.start, span.end)))
        if not rows and must:
            raise ValueError(f"no rows for {span.symbol}")
        for r in rows:
            yield (span.symbol, *r)


class VendorReader(_Fetching, DataSourceReader):
    """One partition a symbol and span.  Filters on symbol and date narrow what is fetched; Spark still applies them."""

    def __init__(self, options: dict, fetch: Callable):
        super().__init__(options, fetch)
        self.must = True

    def pushFilters(self, filters):
        day = lambda f, by=0: (f.value + datetime.timedelta(days=by)).isoformat()
        later = lambda x: x if self.start is None else max(x, self.start)
        sooner = lambda x: x if self.end is None else min(x, self.end)
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column == "symbol" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = [s for s in self.symbols if s in wanted]
            elif column == "date" and isinstance(getattr(f, "value", None), datetime.date):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.start = later(day(f, isinstance(f, GreaterThan)))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.end = sooner(day(f, -isinstance(f, LessThan)))
                self.must = False  # days that were asked for may hold no bar
            yield f

    def partitions(self):
        return [p for s in self.symbols for p in spans(s, self.start, self.end)]

    def read(self, partition):
        if partition is not None:  # no symbol or no day is left
            yield from self.rows(partition, self.must and partition.start == self.start)


class VendorStream(_Fetching, DataSourceStreamReader):
    """Days as offsets: a batch fetches the days after the last one that was committed, up to the last whose session is over.

    today() -> ISO date of that last day.  Which days a batch holds is in the stream's log before they are fetched, so a
    stream that is stopped and started again fetches the same days for that batch, and no day for two.
    """

    def __init__(self, options: dict, fetch: Callable, today: Callable[[], str]):
        super().__init__(options, fetch)
        self.today = today

    def initialOffset(self):
        return {"through": (datetime.date.fromisoformat(self.start) - datetime.timedelta(days=1)).isoformat()}

    def latestOffset(self):
        return {"through": max(self.today(), self.initialOffset()["through"])}

    def partitions(self, start, end):
        first = (datetime.date.fromisoformat(start["through"]) + datetime.timedelta(days=1)).isoformat()
        return [p for s in self.symbols for p in spans(s, first, end["through"])] or [Span("", None, None)]

    def read(self, partition):
        if partition.symbol:
            yield from self.rows(partition, False)

    def commit(self, end):
        """Nothing is kept outside the stream's own log."""


def source_of(fetch: Callable, name: str = "daily_bars", today: Callable[[], str] | None = None) -> type[DataSource]:
    """A data source class that calls fetch(symbol, first day, last day) -> rows (date, open, ..., volume) on executors; today makes it a stream's, too."""

    class Vendor(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return COLUMNS

        def reader(self, schema):
            return VendorReader(self.options, fetch)

        def streamReader(self, schema):
            return VendorStream(self.options, fetch, today or (lambda: datetime.date.today().isoformat()))

    return Vendor


def fetch_bars(spark: SparkSession, fetch: Callable, symbols: list[str], start: str, end: str | None = None) -> DataFrame:
    """Bars of the symbols; filters on symbol and date reach the vendor."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source_of(fetch))
    reader = spark.read.format("daily_bars").option("symbols", ",".join(symbols)).option("start", start)
    return (reader.option("end", end) if end else reader).load()


def stream_bars(spark: SparkSession, fetch: Callable, symbols: list[str], start: str, today: Callable[[], str]) -> DataFrame:
    """Bars from start on as a stream, whose offsets are days."""
    spark.dataSource.register(source_of(fetch, "daily_bars_stream", today))
    return spark.readStream.format("daily_bars_stream").option("symbols", ",".join(symbols)).option("start", start).load()


def fetch_text(url: str, timeout: float = 20.0, opener: Callable | None = None) -> str:
    """A page's text; ValueError for any answer but 200, without query values, as they may hold a key."""
    from urllib.request import urlopen

    with (opener or urlopen)(url, timeout=timeout) as answer:
        if answer.status != 200:
            raise ValueError(f"{url.split('?')[0]}: {answer.status}")
        return answer.read().decode("utf-8-sig")


def fetch_release_dates(base: str, release_id: int, key: str, start: str, get: Callable = fetch_text) -> str:
    """JSON of a release's dates, past and scheduled."""
    try:
        return get(f"{base}/release/dates?release_id={release_id}&realtime_start={start}&include_release_dates_with_no_data=true&limit=10000&sort_order=asc&file_type=json&api_key={key}")
    except Exception as e:
        raise ValueError(f"release {release_id}: {str(e).replace(key, '***')}") from None


def fetch_release_name(base: str, release_id: int, key: str, get: Callable = fetch_text) -> str:
    import json

    try:
        return json.loads(get(f"{base}/release?release_id={release_id}&file_type=json&api_key={key}"))["releases"][0]["name"]
    except Exception as e:
        raise ValueError(f"release {release_id}: {str(e).replace(key, '***')}") from None
