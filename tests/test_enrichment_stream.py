"""A stream of episodes: asked once, paid once, within the budget, whatever breaks off."""

import datetime
import json
import os
from dataclasses import replace

import pytest

from tidewatch.operators.enrichment import NARROW
from tidewatch.settings import SETTINGS
from tidewatch.sources import versions
from tidewatch.streaming.enrichment import Enricher, run_available

SCHEMA = ", ".join(f"{k} {t}" for k, t in NARROW.items())


def episodes(spark, days, status="closed"):
    rows = [(f"{d}_gap", *[datetime.date.fromisoformat(d)] * 3, "down", "gap", -0.02, *[datetime.date.fromisoformat(d)] * 2, status, [], [], "surprise") for d in days]
    return spark.createDataFrame(rows, SCHEMA)


def sender(log, bad=()):
    """Answers every request, on whatever worker, and notes for which episode it was asked."""

    def send(request):
        day = next(x for x in request["messages"][0]["content"].split() if x.endswith("_gap"))
        with open(log, "a") as out:
            out.write(day + "\n")
        if day in bad:
            raise OSError("SECRET")
        answer = {"status": "unexplained", "headline": "h", "summary": "s", "category": "other", "region": "US", "drivers": [], "sources": [], "confidence": 0.5, "conflicting_sources": False}
        return {"stop_reason": "end_turn", "content": [{"type": "text", "text": json.dumps(answer)}], "usage": {"input_tokens": 1_000_000, "output_tokens": 0, "web_search_requests": 1}}

    return send


@pytest.fixture
def made(spark, tmp_path):
    prices = spark.createDataFrame([("m", 0.5, 1.0)], "model string, input_usd double, output_usd double")
    log = str(tmp_path / "asked")

    def make(bad=(), **settings):
        return Enricher(str(tmp_path / "root"), sender(log, bad), "m", prices, lambda: "then", replace(SETTINGS, reserve_usd=1.0, **settings), callers=2, sleep=lambda s: None)

    make.asked = lambda: sorted(open(log).read().split()) if os.path.exists(log) else []
    return make


def ids(df):
    return sorted(r.episode_id for r in df.select("episode_id").collect())


def test_a_batch_that_runs_twice_asks_and_pays_once(spark, made):
    batch, e = episodes(spark, ["2020-01-01", "2020-01-02", "2020-01-03"]), made()
    e(batch, 0)
    e(batch, 0)
    e(batch.union(batch), 1)  # the same episodes once more, in a later batch
    assert made.asked() == ["2020-01-01_gap", "2020-01-02_gap", "2020-01-03_gap"] == ids(e.table(spark, "records"))
    ledger = {r.run_id: r for r in e.table(spark, "ledger").collect()}
    assert ledger["batch-0"].cost_usd == pytest.approx(3 * 0.51) and ledger["batch-0"].episodes_written == 3 and ledger["batch-0"].mode == "enrich"
    assert ledger["batch-1"].cost_usd == 0 and ledger["batch-1"].episodes_attempted == 0 and e.table(spark, "waiting").count() == 0
    r = e.table(spark, "records").first()
    assert (r.provider, r.model, r.enriched_at, r.status, r.usage.input_tokens) == ("search", "m", "then", "unexplained", 1_000_000)


@pytest.mark.parametrize("step", ["merge", "replace"])
def test_a_batch_that_breaks_off_goes_on(spark, made, monkeypatch, step):
    """After the replies are kept nothing is asked again; the reserve stays in the ledger until then."""
    batch, e, real = episodes(spark, ["2020-01-01", "2020-01-02"]), made(), getattr(versions, step)

    def breaks(df, path, *more):
        if path.endswith(("records", "waiting")):
            raise InterruptedError
        return real(df, path, *more)

    monkeypatch.setattr(versions, step, breaks)
    with pytest.raises(InterruptedError):
        e(batch, 0)
    monkeypatch.undo()
    kept = e.table(spark, "ledger").first()
    assert (kept.mode, kept.cost_usd) == ("reserved", 2.0) and len(made.asked()) == 2
    made()(batch, 0)
    assert len(made.asked()) == 2 and ids(e.table(spark, "records")) == ["2020-01-01_gap", "2020-01-02_gap"]
    assert [(r.run_id, r.mode, round(r.cost_usd, 6)) for r in e.table(spark, "ledger").collect()] == [("batch-0", "enrich", 1.02)]


def test_budget_and_failures_wait(spark, made):
    e = made(bad=("2020-01-01_gap",), budget_usd=2.6)
    e(episodes(spark, ["2020-01-03", "2020-01-01", "2020-01-02"]), 0)  # two calls are affordable, the oldest first
    assert made.asked() == ["2020-01-01_gap", "2020-01-02_gap"] and ids(e.table(spark, "records")) == ["2020-01-02_gap"]
    assert ids(e.table(spark, "waiting")) == ["2020-01-01_gap", "2020-01-03_gap"]
    first = e.table(spark, "ledger").first()
    assert (first.failures, first.episodes_attempted, first.episodes_written) == (1, 2, 1) and first.cost_usd == pytest.approx(0.51)
    assert "SECRET" not in str(versions.read(spark, e.root + "/replies").collect())
    made(budget_usd=10.0)(episodes(spark, ["2020-01-04"]), 1)
    assert ids(e.table(spark, "records")) == [f"2020-01-0{k}_gap" for k in (1, 2, 3, 4)] and e.table(spark, "waiting").count() == 0
    with pytest.raises(ValueError, match="no episode ids"):
        e(episodes(spark, ["2020-01-05"]).selectExpr("'e1' AS episode_id", *list(NARROW)[1:]), 2)


def test_a_stream_of_episodes(spark, made, tmp_path):
    src, e = str(tmp_path / "in"), made()
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    for part in (episodes(spark, ["2020-01-01"]), episodes(spark, ["2020-01-02"], "open"), episodes(spark, ["2020-01-01", "2020-01-03"])):
        part.coalesce(1).write.mode("append").parquet(src)
        run_available(read(), e, str(tmp_path / "check"))
    assert made.asked() == ["2020-01-01_gap", "2020-01-03_gap"] == ids(e.table(spark, "records"))
