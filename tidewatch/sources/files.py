"""Tables and documents on disk: explicit schemas, whole-or-nothing writes.

Tables go through Hadoop's file systems, so any store Spark reaches will do.  A new version is written beside the old
one, as path.new-TOKEN; then the old one becomes path.old-TOKEN, the new one takes its name, and the old one goes.  A
stop between these steps leaves the pair behind, and whoever next reads or writes path finishes the step: as the new
version was whole before the old one moved, it takes the name; without it the old one gets its name back.  So there is
always one version to be read.  Documents (records, overrides, ledger, meta) are small JSON files whose new version
takes the name in one rename.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPISODE_SCHEMA = (
    "symbol string, episode_id string, start_date date, end_date date, anchor_date date, direction string, trigger string, triggers string, move_pct double, max_z double, "
    "severity double, search_from date, search_to date, recovery_date date, status string, detector_version int, scheduled_releases array<string>, unscheduled_releases array<string>, catalyst string"
)
CALENDAR_SCHEMA = "date date, release string, release_type string, scheduled boolean, source_url string"
META_SCHEMA = "symbol string, first_day date, last_day date, rows long, source string, detector_version int, refreshed_at timestamp"
META_DOCUMENT = "schema_version int, ticker string, source string, last_refresh string, first_trading_day date, last_trading_day date, row_counts struct<prices:long>, detector_version int"
RECORD_SCHEMA = (
    "episode_id string, status string, headline string, summary string, category string, region string, scheduled boolean, drivers array<string>, "
    "sources array<struct<title:string,url:string,publisher:string,published:date>>, confidence double, conflicting_sources boolean, reviewed boolean, rejected boolean, "
    "provider string, model string, prompt_version string, web_search_tool string, enriched_at string, search_from date, search_to date, "
    "usage struct<input_tokens:long,output_tokens:long,web_search_requests:long>, cost_usd double, stop_reasons array<string>, dropped_sources array<struct<url:string,reason:string>>, raw_response string"
)
OVERRIDE_SCHEMA = "episode_id string, action string, fields map<string,string>, reviewed_at string, note string"
LEDGER_SCHEMA = "run_id string, provider string, model string, prompt_version string, episodes_attempted long, episodes_written long, failures long, input_tokens long, output_tokens long, web_search_requests long, cost_usd double, mode string"


#: Times 50 ms that are left to a writer between its steps, before a reader finishes them.
GRACE = 10


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def adopt(spark: SparkSession, path: str) -> None:
    """Finish a replacement of path that was broken off."""
    fs, there = _fs(spark, path)
    left = [s.getPath() for s in fs.globStatus(_fs(spark, f"{path}.old-*")[1]) or []]
    for _ in range(GRACE if left and not fs.exists(there) else 0):  # a writer at work is done in a moment
        time.sleep(0.05)
        if fs.exists(there):
            break
    for old in left:
        _, new = _fs(spark, f"{path}.new-{old.getName().rsplit('.old-', 1)[1]}")
        if fs.exists(there):
            fs.delete(old, True)
        elif fs.exists(new):
            fs.rename(new, there)
            fs.delete(old, True)
        else:
            fs.rename(old, there)


def exists(spark: SparkSession, path: str) -> bool:
    adopt(spark, path)
    fs, p = _fs(spark, path)
    return fs.exists(p)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    """staged, whole, takes path's name; the old version goes once the new one stands."""
    adopt(spark, path)
    token = uuid.uuid4().hex
    fs, new = _fs(spark, staged)
    (_, there), (_, old), (_, ready) = _fs(spark, path), _fs(spark, f"{path}.old-{token}"), _fs(spark, f"{path}.new-{token}")
    if not fs.exists(there):
        fs.mkdirs(there.getParent())
        if not fs.rename(new, there):
            raise OSError(f"can't write {path}")
        return
    for a, b in ((new, ready), (there, old), (ready, there)):
        try:
            moved = fs.rename(a, b)
        except Exception:
            moved = False
        # a reader that came between the last two steps has finished the replacement
        if not moved and not (a is ready and fs.exists(there) and not fs.exists(ready)):
            adopt(spark, path)
            raise OSError(f"can't move {a} to {b}")
    fs.delete(old, True)


def write_table(df: DataFrame, path: str, sort: tuple[str, ...] = (), check=None) -> None:
    """Write beside path, read it back for check (which raises to refuse it), then swap."""
    spark, staged = df.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(staged)
    if check is not None:
        try:
            check(spark.read.schema(df.schema).parquet(staged))
        except Exception:
            fs, p = _fs(spark, staged)
            fs.delete(p, True)
            raise
    swap(spark, staged, path)


def write_prices(bars: DataFrame, path: str, source: str, check=None) -> None:
    write_table(bars.withColumn("source", F.lit(source)), path, ("symbol", "date"), check)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table with its declared schema; a missing one is an error."""
    adopt(spark, path)
    return spark.read.schema(schema).parquet(path)


def write_episodes(episodes: DataFrame, path: str, check=None) -> None:
    write_table(episodes, path, ("symbol", "start_date", "episode_id"), check)


def write_calendar(calendar: DataFrame, path: str, check=None) -> None:
    write_table(calendar, path, ("date", "release", "release_type"), check)


def write_document(spark: SparkSession, path: str, payload: dict) -> None:
    """Sorted keys, indented, a line feed at the end; whole or not at all."""
    write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True, default=str) + "\n")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file whose new version takes the old one's name in one rename."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staged, there = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.staged-{uuid.uuid4().hex}", path))
    own = jvm.org.apache.hadoop.fs.FileSystem.newInstance(there.toUri(), conf)
    try:
        own.setWriteChecksum(False)  # a local file's checksum is a second file, which no rename moves along with it
        out = own.create(staged)
        out.write(bytearray(text.encode()))
        out.close()
        how = spark._sc._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        how[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.getUri(), conf)
        context.rename(staged, there, how)
    finally:
        own.close()


def write_meta(spark: SparkSession, path: str, meta: DataFrame) -> None:
    """The snapshot's document: meta holds one row with the fields of META_DOCUMENT."""
    rows = meta.select(*[f.name for f in T._parse_datatype_string(META_DOCUMENT)]).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a snapshot's document is about one series")
    write_document(spark, path, rows[0].asDict(recursive=True))


def write_rows(df: DataFrame, path: str, name: str, key: str, most: int = 100_000) -> None:
    """A reviewed list (records, overrides, ledger runs) as one document, by key; more than most rows is an error."""
    rows = df.orderBy(key).select(F.to_json(F.struct(*df.columns)).alias("j")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name}: more than {most} rows belong in a table")
    write_document(df.sparkSession, path, {"schema_version": 1, name: [json.loads(r.j) for r in rows]})


def read_rows(spark: SparkSession, path: str, name: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """The rows of a document under name; none if it is missing and may be.  Overrides go through enrichment.read_overrides, which checks them."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    of = T._parse_datatype_string(schema)
    outer = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField(name, T.ArrayType(of))])
    return spark.read.schema(outer).option("multiLine", True).json(path).select(F.inline(name))


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot's document; a missing one is an error."""
    return spark.read.schema(META_DOCUMENT).option("multiLine", True).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """html, source_url of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("source_url"))
