import io
import json
from html import unescape

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import enrichment as E
from tidewatch.operators import reports, snapshots
from tidewatch.sources import bars as prices
from tidewatch.sources import files, vendor


@pytest.mark.parametrize("status,n,conf,conflict,reviewed,want", [
    ("explained", 0, 0.9, False, True, "unexplained"), ("unexplained", 2, 0.9, False, False, "unexplained"), ("needs_review", 2, 0.9, False, True, "needs_review"),
    ("explained", 1, 0.1, True, True, "explained"), ("explained", 1, 0.49, False, False, "needs_review"), ("explained", 1, 0.9, True, False, "needs_review"),
    ("needs_review", 1, 0.9, False, False, "needs_review"), ("explained", 1, 0.5, False, False, "explained"),
])
def test_status_table(spark, status, n, conf, conflict, reviewed, want):
    got = spark.range(1).select(E.status_rule(F.lit(status), F.lit(n), F.lit(conf), F.lit(conflict), F.lit(reviewed), 0.5)).first()[0]
    assert got == want


def test_dates_in_any_order(spark):
    """Twenty-odd shapes of one date, and texts that tell none, or two."""
    same = [
        "March 16, 2020", "Mar 16 2020", "16 March 2020", "16th of March, 2020", "2020 March 16", "2020, 16th March", "March 2020, the 16th", "Mon, 16 Mar 2020 10:30:00 GMT", "16-Mar-2020", "Mar-16-2020", "2020-Mar-16",
        "2020-03-16", "2020-03-16T10:00:00Z", "2020/3/16", "2020.03.16", "3/16/2020", "16/03/2020", "16.03.2020", "16-3-2020", "03-16-2020", "published on Monday the 16th, March 2020 at 9:45 pm", "MARCH 16TH 2020 (updated)", "Year 2020, month March, day 16", "at 7 pm on 16. march 2020",
    ]
    none = ["3 days ago", "yesterday", "March 16", "March 2020", "2020", "16 2020", "March 16 or 17 in 2020, who knows", "January or March in 2020, the 16th", "in 2019 and 2020, March, 16", "Foo 99, 2020", "February 30, 2020", "99/99/2020", "room 1234, March 5", ""]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(same + none)], "k int, age string").select("k", "age", text.page_date(F.col("age")).alias("at"))
    got = {r.k: (r.age, None if r["at"] is None else str(r["at"])) for r in d.collect()}
    assert [got[k] for k in range(len(same)) if got[k][1] != "2020-03-16"] == []
    assert [got[k] for k in range(len(same), len(got)) if got[k][1] is not None] == []
    assert str(spark.range(1).select(text.page_date(F.lit("03/04/2020"))).first()[0]) == "2020-03-04"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert str(one(text.page_date(F.lit("Updated April 3, 2025 by x")))) == "2025-04-03" and one(text.page_date(F.lit("3 days ago"))) is None
    assert one(text.page_date(F.lit("Foo 99, 2020"))) is None and str(one(text.page_date(F.lit("3 Sep 2021")))) == "2021-09-03"
    assert one(text.publisher(F.lit("https://u@WWW.Example.org:80/a?b"))) == "example.org" and one(text.publisher(F.lit("not a url"))) == "not a url"
    assert one(text.month_number(F.lit("SEP"))) == 9 and one(text.month_number(F.lit("foo"))) is None
    assert one(text.plain_text(F.lit("<b>a&amp;lt;</b>\n b"))) == " a&lt; b"
    assert one(text.signed_percent(F.lit(-0.0512))) == "-5.12%" and one(text.decade(F.lit("1999-05-01").cast("date"))) == "1990s"
    raw = '{"a":[{"cited_text":"x\\"y","k":1},{"cited_text":null}],"encrypted_content":["z",{"b":1}],"encrypted_index":{"c":[]},"d":"cited_text"}'
    assert json.loads(one(E.without_keys(F.lit(raw)))) == {"a": [{"k": 1}, {}], "d": "cited_text"} and one(E.without_keys(F.lit("no json"))) is None
    for html in ("a&amp;lt; b", "&copy 2020", "&#65;&#x42;&#x1F600;&#0;&#150;&#8211;", "&notin; &unknown; &am;p", "&amp", "&", "&NotEqualTilde;", "&#1114112;&#xD800;"):
        assert one(text.unescaped(F.lit(html))) == unescape(html)


def test_sources_in_order_of_reasons(spark):
    claimed = spark.createDataFrame([("e", k, u) for k, u in enumerate(["a", "b", "a", "c", "d", "f"])], "episode_id string, place int, url string")
    results = spark.createDataFrame([("e", "a", "A", "May 5, 2020"), ("e", "b", "B", None), ("e", "c", "C", "yesterday"), ("e", "d", "D", "May 5, 2021")], "episode_id string, url string, title string, page_age string")
    w = spark.createDataFrame([("e", "2020-05-05", "2020-05-05")], "episode_id string, a string, b string").selectExpr("episode_id", "date(a) search_from", "date(b) search_to")
    got = {r.url: r.reason for r in E.check_sources(claimed, results, w).collect()}
    assert got == {"a": None, "b": "no_page_age", "c": "unparseable_page_age", "d": "outside_window", "f": "not_in_search_results"}
    row = E.sources_of(E.check_sources(claimed, results, w)).first()
    assert [s.title for s in row.sources] == ["A"] and [x.url for x in row.dropped_sources] == ["b", "c", "d", "f"]


def test_documents_round_trip(spark, tmp_path):
    path = str(tmp_path / "runs.json")
    assert files.read_rows(spark, path, "runs", files.LEDGER_SCHEMA).count() == 0
    df = spark.createDataFrame([("b", 1.5), ("a", 2.5)], "run_id string, cost_usd double")
    files.write_rows(df, path, "runs", "run_id")
    files.write_rows(df, path, "runs", "run_id")
    assert [r.run_id for r in files.read_rows(spark, path, "runs", files.LEDGER_SCHEMA).collect()] == ["a", "b"]
    assert E.ledger_total(files.read_rows(spark, path, "runs", files.LEDGER_SCHEMA)).first()[0] == 4.0


def test_refused_table_keeps_the_old_one(spark, tmp_path, make_bars):
    path = str(tmp_path / "prices")
    files.write_prices(make_bars([1, 2, 3]), path, "a")

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        files.write_prices(make_bars([1, 2]), path, "b", refuse)
    kept = spark.read.parquet(path)
    assert kept.count() == 3 and kept.first().source == "a" and len(list(tmp_path.iterdir())) == 1


def test_vendor_source_and_retry(spark):
    def fetch(symbol, start, end):
        import datetime

        return [(datetime.date(2024, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0, float(len(symbol)))]

    assert {(r.symbol, r.volume) for r in vendor.fetch_bars(spark, fetch, ["A", "BB"], "2024-01-01").collect()} == {("A", 1.0), ("BB", 2.0)}
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert vendor.with_retry(flaky, sleep=waits.append) == 7 and waits == [2.0, 4.0]
    with pytest.raises(ValueError) as e:
        vendor.fetch_release_dates("https://x", 1, "KEY", "2020-01-01", get=lambda u: (_ for _ in ()).throw(OSError(u)))
    assert "KEY" not in str(e.value)


def test_fetching_text_and_names():
    class Answer(io.BytesIO):
        status = 200

    asked = []

    def opener(url, timeout):
        asked.append((url, timeout))
        answer = Answer(b"\xef\xbb\xbfpage")
        answer.status = 404 if "gone" in url else 200
        return answer

    assert vendor.fetch_text("https://x/a", 5.0, opener) == "page" and asked == [("https://x/a", 5.0)]
    with pytest.raises(ValueError, match="https://x/gone: 404") as e:
        vendor.fetch_text("https://x/gone?api_key=KEY", 5.0, opener)
    assert "KEY" not in str(e.value)
    assert vendor.fetch_release_name("https://x", 10, "KEY", get=lambda url: '{"releases": [{"name": "Prices"}]}') == "Prices"
    with pytest.raises(ValueError, match="release 10") as e:
        vendor.fetch_release_name("https://x", 10, "KEY", get=lambda url: (_ for _ in ()).throw(OSError(url)))
    assert "KEY" not in str(e.value)
    assert vendor.fetch_release_dates("https://x", 10, "KEY", "2020-01-01", get=lambda url: url).startswith("https://x/release/dates?release_id=10")


def test_cost_of_unknown_model(spark):
    u = spark.createDataFrame([("m", 1, 1, 1)], "model string, input_tokens long, output_tokens long, web_search_requests long")
    with pytest.raises(Exception, match="no price"):
        E.cost(u, spark.createDataFrame([("n", 1.0, 1.0)], "model string, input_usd double, output_usd double")).collect()


RECORD = {"episode_id": "e", "status": "needs_review", "headline": "h", "summary": "s", "category": "other", "region": "US", "drivers": ["d"], "sources": [("t", "https://a", "a", None)], "confidence": 0.9, "conflicting_sources": False, "reviewed": False, "rejected": False}
KINDS = "episode_id string, status string, headline string, summary string, category string, region string, drivers array<string>, sources array<struct<title:string,url:string,publisher:string,published:date>>, confidence double, conflicting_sources boolean, reviewed boolean, rejected boolean"


def record(spark, **changes):
    return spark.createDataFrame([tuple({**RECORD, **changes}.values())], KINDS)


def test_faults_of_form(spark):
    fault = lambda **c: [r.fault for r in E.record_faults(record(spark, **c)).collect()]
    assert fault() == [] and fault(category="inflation") == ["unknown category"] and fault(region=None) == ["unknown region"] and fault(status="odd") == ["unknown status"]
    assert fault(confidence=float("nan")) == fault(confidence=None) == ["confidence outside 0 to 1"] and fault(sources=[("t", None, "a", None)]) == ["source without http"] and fault(headline="x" * 91) == ["headline too long"]


def test_overrides_are_checked(spark, tmp_path):
    kinds = "episode_id string, action string, fields map<string,string>, reviewed_at string, note string"
    rows = [("a", "edit", {"category": "odd"}), ("b", "edit", {"drivers": "no list"}), ("c", "edit", {"headline": "x" * 91}), ("d", "edit", {"sources": "x"}), ("e", "accept", {"headline": "x"}), ("f", "drop", None), ("g", "edit", {"status": "explained", "drivers": '["x"]'}), ("h", "accept", None)]
    o = spark.createDataFrame([(*r, "now", "") for r in rows], kinds)
    assert {r.episode_id: r.fault for r in E.override_faults(o).collect()} == {"a": "unknown category", "b": "drivers are no list", "c": "headline too long", "d": "not editable: sources", "e": "fields without edit", "f": "unknown action"}
    path = str(tmp_path / "o.json")
    assert E.read_overrides(spark, path).count() == 0
    E.write_overrides(o.filter("episode_id > 'f'"), path)
    assert [r.episode_id for r in E.read_overrides(spark, path).orderBy("place").collect()] == ["g", "h"]
    E.write_overrides(o, path)
    with pytest.raises(ValueError, match="unknown category"):
        E.read_overrides(spark, path)
    bad = o.filter("episode_id = 'a'").withColumn("place", F.lit(1)).withColumn("episode_id", F.lit("e"))
    with pytest.raises(Exception, match="unknown category"):
        E.apply_overrides(record(spark), bad).collect()


def test_ids(spark):
    ids = ["2020-02-29_gap", "2021-02-29_gap", "2020-2-29_gap", "2020-02-29_crash", "2020-02-29", None]
    assert [r.episode_id for r in E.bad_ids(spark.createDataFrame([(x,) for x in ids], "episode_id string")).collect()] == ids[1:]


# replacement


def names(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


@pytest.mark.parametrize("steps,want", [(0, 3), (1, 3), (2, 2), (3, 2)])
def test_a_replacement_that_stops_between_steps(spark, tmp_path, make_bars, steps, want):
    """However far a replacement came, one whole version is read, and nothing else is left."""
    path = tmp_path / "prices"
    files.write_prices(make_bars([1, 2, 3]), str(path), "a")
    make_bars([1, 2]).write.parquet(str(tmp_path / "prices.staged"))
    for a, b in [("prices.staged", "prices.new-7"), ("prices", "prices.old-7"), ("prices.new-7", "prices")][:steps]:
        (tmp_path / a).rename(tmp_path / b)
    assert files.exists(spark, str(path)) and prices.read_prices(spark, str(path)).count() == want
    if steps > 1:
        assert names(tmp_path) == ["prices"]
    files.write_prices(make_bars([1, 2, 3, 4]), str(path), "b")
    assert prices.read_prices(spark, str(path)).count() == 4 and not [x for x in names(tmp_path) if ".old" in x]


def test_the_old_version_comes_back_without_a_new_one(spark, tmp_path, make_bars):
    path = tmp_path / "prices"
    files.write_prices(make_bars([1, 2, 3]), str(path), "a")
    path.rename(tmp_path / "prices.old-7")
    assert prices.read_prices(spark, str(path)).count() == 3 and names(tmp_path) == ["prices"]


def test_documents_take_their_name_in_one_step(spark, tmp_path, monkeypatch):
    """A writer that stops before the rename leaves the old document; the ledger is never empty."""
    path = str(tmp_path / "ledger.json")
    runs = spark.createDataFrame([("a", 1.5)], "run_id string, cost_usd double")
    files.write_rows(runs, path, "runs", "run_id")
    (tmp_path / "ledger.json.staged-1").write_text('{"runs": [')
    assert E.ledger_total(files.read_rows(spark, path, "runs", files.LEDGER_SCHEMA)).first()[0] == 1.5
    files.write_rows(runs.unionByName(runs.withColumn("run_id", F.lit("b"))), path, "runs", "run_id")
    assert json.loads((tmp_path / "ledger.json").read_text())["runs"][1]["run_id"] == "b" and names(tmp_path) == ["ledger.json", "ledger.json.staged-1"]


def test_snapshot_document(spark, tmp_path, make_bars):
    path = str(tmp_path / "meta.json")
    with pytest.raises(Exception):
        files.read_meta(spark, path).collect()
    files.write_meta(spark, path, snapshots.document(make_bars([1, 2, 3]), "2024-02-01T10:00:00+00:00"))
    raw = (tmp_path / "meta.json").read_text()
    assert json.loads(raw) == {"schema_version": 1, "ticker": "X", "source": "test", "last_refresh": "2024-02-01T10:00:00Z", "first_trading_day": "2024-01-01", "last_trading_day": "2024-01-03", "row_counts": {"prices": 3}, "detector_version": 1}
    assert raw.endswith("}\n") and list(json.loads(raw)) == sorted(json.loads(raw)) and files.read_meta(spark, path).first().row_counts.prices == 3


# reports


def test_calibration_report(spark):
    e = spark.createDataFrame([("X", "2020-03-16_shock", "2020-03-12", "2020-03-16", "shock", "closed", "surprise", "down", -0.12), ("X", "2021-01-04_gap", "2021-01-04", "2021-01-04", "gap", "open", "scheduled", "up", 0.02)], "symbol string, episode_id string, s string, e string, trigger string, status string, catalyst string, direction string, move_pct double").selectExpr("*", "date(s) start_date", "date(e) end_date")
    c = spark.createDataFrame([("2020-03-15", "FOMC", False), ("2020-03-11", "CPI", True)], "d string, release string, scheduled boolean").selectExpr("date(d) date", "release", "scheduled")
    probe = lambda d: spark.createDataFrame([("crash", d)], "label string, d string").selectExpr("label", "date(d) probe")
    told = reports.calibration_report(e, c, probe("2020-03-13"))
    assert told == reports.calibration_report(e.repartition(3), c.repartition(2), probe("2020-03-13"))
    for line in ("Total: 2", "| shock | 1 |", "| 2020s | 2 |", "| crash | 2020-03-13 | 2020-03-16_shock | 2020-03-12 | 2020-03-16 | shock | -0.1200 | surprise |", "| FOMC | 1 | 2020-03-15 | 2020-03-15 | 1 |", "| `z_threshold` | `2.5` |"):
        assert line in told.split("\n"), line
    with pytest.raises(ValueError, match="crash: 0 episodes"):
        reports.calibration_report(e, c, probe("2019-01-01"))


def test_budget_report(spark):
    usd = spark.createDataFrame([("base", 1.0, 6.0), ("large", 3.0, 10.0)], "model string, input_usd double, output_usd double")
    e = spark.createDataFrame([(f"e{k}", "closed" if k else "open") for k in range(11)], "episode_id string, status string")
    none = spark.createDataFrame([], files.LEDGER_SCHEMA)
    told = reports.budget_report(usd, e, none, "base", "large")
    for line in ("Closed episodes: 10", "All of them, base: $0.23", "2 of them again, large: $0.07", "Searches at the cap of 3: $0.30", "Reserve: $2.50", "No run so far.", "Left: $25.00"):
        assert line in told.split("\n"), line
    runs = spark.createDataFrame([("r1", "enrich", "base", 3, 4, 1.25)], "run_id string, mode string, model string, episodes_written long, web_search_requests long, cost_usd double")
    spent = reports.budget_report(usd, e, runs, "base", "large").split("\n")
    assert "| r1 | enrich | base | 3 | 4 | 1.25 |" in spent and "Left: $23.75" in spent
    with pytest.raises(ValueError, match="no price"):
        reports.budget_report(usd, e, none, "other", "large")


def test_enrichment_report(spark):
    base = {"drivers": ["d"], "sources": [("t", "https://a", "a", None)], "confidence": 0.9, "conflicting_sources": False, "reviewed": False, "rejected": False}
    kinds = KINDS + ", provider string, model string, prompt_version string, usage struct<input_tokens:long,output_tokens:long,web_search_requests:long>, cost_usd double, stop_reasons array<string>, dropped_sources array<struct<url:string,reason:string>>"
    rows = [("e1", "explained", "h1"), ("e2", "needs_review", "h2"), ("e3", "needs_review", "h3")]
    records = spark.createDataFrame([(i, s, h, "s", "other", "US", *base.values(), "search", "m", "v1", (1, 1, 2), 0.1, ["end_turn"], [("u", "no_page_age")]) for i, s, h in rows], kinds)
    e = spark.createDataFrame([(f"e{k}", "closed") for k in range(1, 5)] + [("e9", "open")], "episode_id string, status string")
    o = spark.createDataFrame([("e3", "accept", None, "now", "", 1)], "episode_id string, action string, fields map<string,string>, reviewed_at string, note string, place int")
    ledger = spark.createDataFrame([("r", 1.5)], "run_id string, cost_usd double")
    told = reports.enrichment_report(e, records, o, ledger, ["sk-secret"]).split("\n")
    for line in ("Closed episodes: 4", "Current records: 3", "Missing: 1", "- e4", "- e2", "Reviewed: 1", "| needs_review | 2 |", "| explained | 2 |", "| no_page_age | 3 |", "| end_turn | 3 |", "Total: 6", "Most for one episode: 2", "Spent: $1.50", "PASS"):
        assert line in told, line
    assert "- e3" not in told and "FAIL" in reports.enrichment_report(e, records, o, ledger, ["H2"])
    one = {r.episode_id: r for r in reports.record_table(records, e).collect()}
    assert one["e1"].found and one["e1"].dropped_reasons == "no_page_age" and not one["e4"].found and one["e4"].status is None
