"""Explanations for a stream of episodes, asked and paid once.

A batch is one pass of three jobs, however many episodes it brings: the executors ask, a job reads all replies, and a join
by key puts the records into their table.  Tables are versioned (sources.versions), so a batch that is broken off
anywhere and comes again goes on from what stands:

* before anything is asked the ledger holds a run for the batch, with what its calls may cost at most; what no budget is
  left for waits, and is asked with a later batch;
* the replies are kept as a version of their own that names the batch, and are never asked for again;
* records replace those of their episodes; a run that the ledger holds as done is passed over.

What fails, or what the budget doesn't allow, stays in the table of waiting episodes.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import enrichment as E
from ..operators.providers import RESPONSES, answer_schema, turn
from ..settings import SETTINGS, Settings
from ..sources import files, versions

NARROWED = ", ".join(f"{k} {t}" for k, t in E.NARROW.items())
#: Replies with what went wrong instead of them.
ASKED = f"{RESPONSES}, failed string"


class Enricher:
    """foreachBatch over closed episodes.  send(request) -> reply runs on executors, which has to pickle; prices: model, input_usd, output_usd."""

    def __init__(
        self, root: str, send: Callable[[dict], dict], model: str, prices: DataFrame, enriched_at: Callable[[], str], settings: Settings = SETTINGS, callers: int = 8,
        sleep: Callable = time.sleep, may_retry: tuple[type[Exception], ...] = (ConnectionError, TimeoutError),
    ):
        self.root, self.send, self.model, self.prices, self.enriched_at = root.rstrip("/"), send, model, prices, enriched_at
        self.settings, self.callers, self.sleep, self.may_retry = settings, callers, sleep, may_retry

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """records, ledger, waiting, as they stand."""
        schema = {"records": files.RECORD_SCHEMA, "ledger": files.LEDGER_SCHEMA, "waiting": NARROWED}[name]
        return versions.read(spark, f"{self.root}/{name}", schema)

    def _run(self, spark: SparkSession, run: str, mode: str, **figures) -> None:
        names = [f.name for f in T._parse_datatype_string(files.LEDGER_SCHEMA)]
        row = dict.fromkeys(names, 0) | {"run_id": run, "provider": "search", "model": self.model, "prompt_version": self.settings.prompt_version, "cost_usd": 0.0, "mode": mode} | figures
        versions.merge(spark.createDataFrame([tuple(row[k] for k in names)], files.LEDGER_SCHEMA), f"{self.root}/ledger", "run_id", run)

    def _affordable(self, spark: SparkSession, run: str) -> int:
        """Calls that the budget allows beside what other runs have spent or reserved."""
        spent = E.ledger_total(self.table(spark, "ledger").filter(F.col("run_id") != run)).first()[0]
        return max(0, int((self.settings.budget_usd - spent) / self.settings.reserve_usd + 1e-9))

    def _asked(self, todo: DataFrame, run: str) -> DataFrame:
        """Replies to a prompt for each row of todo, as a version that names the run."""
        send, model, schema, settings, sleep, may_retry = self.send, self.model, answer_schema(), self.settings, self.sleep, self.may_retry
        names = [part.split()[0] for part in ASKED.split(", ")]

        def ask(batches):
            import pyarrow as pa

            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            for batch in batches:
                for episode_id, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    try:
                        rows = [(*r, None) for r in turn(send, model, schema, settings, sleep, may_retry, episode_id, prompt)]
                    except ValueError as e:
                        rows = [(episode_id, 0, None, None, 0, 0, 0, str(e))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        prompts = E.prompts(E.narrowed(todo), settings).select("episode_id", "prompt")
        replies = prompts.repartition(self.callers, "episode_id").mapInArrow(ask, ASKED)
        spark, path = todo.sparkSession, f"{self.root}/replies"
        return versions.commit(replies, path, versions.version(spark, path).number, run).read(spark)

    def _kept(self, spark: SparkSession, run: str) -> DataFrame | None:
        path = f"{self.root}/replies"
        for n in reversed(versions.numbers(spark, path)):
            v = versions.version(spark, path, n)
            if v.note == run:
                return v.read(spark)
        return None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, run, s = batch.sparkSession, f"batch-{batch_id}", self.settings
        if self.table(spark, "ledger").filter((F.col("run_id") == run) & (F.col("mode") == "enrich")).limit(1).count():
            return
        new = E.narrowed(batch).dropDuplicates(["episode_id"])
        waiting = self.table(spark, "waiting")
        due = new.unionByName(waiting.join(new.select("episode_id"), "episode_id", "left_anti").select(*new.columns))
        if s.strict_ids and (odd := [r.episode_id for r in E.bad_ids(due, s).limit(10).collect()]):
            raise ValueError(f"no episode ids: {odd}")
        pending = E.pending(due, self.table(spark, "records"), settings=s)
        replies = self._kept(spark, run)
        if replies is None:
            todo = pending.limit(self._affordable(spark, run))
            n = todo.count()
            self._run(spark, run, "reserved", episodes_attempted=n, cost_usd=n * s.reserve_usd)
            replies = self._asked(todo, run)
        told = E.answers(replies.filter("failed IS NULL").drop("failed"), due, s).filter("fault IS NULL").drop("fault")
        paid = E.cost(replies.groupBy("episode_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "web_search_requests")]).withColumn("model", F.lit(self.model)), self.prices, s)
        more = {"provider": F.lit("search"), "model": F.lit(self.model), "prompt_version": F.lit(s.prompt_version), "web_search_tool": F.lit("search"), "enriched_at": F.lit(self.enriched_at())}
        full = told.withColumns(more).join(due.select("episode_id", "search_from", "search_to"), "episode_id").join(paid.select("episode_id", "cost_usd"), "episode_id")
        records = full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(files.RECORD_SCHEMA)])
        versions.merge(records, f"{self.root}/records", "episode_id", run)
        versions.replace(E.pending(due, self.table(spark, "records"), settings=s), f"{self.root}/waiting", run)
        tokens = paid.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "web_search_requests", "cost_usd")]).first()
        written = self.table(spark, "records").join(replies.select("episode_id").distinct(), "episode_id", "left_semi").count()
        figures = {c: int(tokens[c]) for c in ("input_tokens", "output_tokens", "web_search_requests")}
        self._run(spark, run, "enrich", episodes_attempted=tokens.n, episodes_written=written, failures=tokens.n - written, cost_usd=float(tokens.cost_usd), **figures)


def run_available(episodes: DataFrame, enricher: Enricher, checkpoint: str) -> None:
    """All that a stream of episodes holds; one batch after the other."""
    closed = episodes.filter("status = 'closed'")
    closed.writeStream.foreachBatch(enricher).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
