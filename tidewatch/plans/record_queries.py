"""Enrichment records, text functions, and built-in operators that the engine leans on."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import text
from ..operators import enrichment as E
from ..operators import reports
from ..settings import SETTINGS
from .base import rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# records made from the events table: one for each event
_STATUS = "CASE event_id % 5 WHEN 0 THEN 'unexplained' WHEN 1 THEN 'needs_review' ELSE 'explained' END"
REC = f"""rec AS (SELECT 'e' || event_id episode_id, event_id, {_STATUS} status, CAST(event_id % 100 AS DOUBLE) / 100 confidence, event_id % 4 n_sources, event_id % 7 = 0 conflicting, event_id % 11 = 0 reviewed,
 CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN 'search' END provider, CASE event_id % 2 WHEN 0 THEN 'v1' ELSE 'v0' END prompt_version, CASE event_id % 2 WHEN 0 THEN 'base' ELSE 'large' END model,
 'h' || event_id headline, CASE event_id % 10 WHEN 3 THEN 'rejected' ELSE 'other' END category FROM events)"""
RULED = "CASE WHEN n_sources = 0 THEN 'unexplained' WHEN status = 'unexplained' THEN 'unexplained' WHEN reviewed THEN status WHEN confidence < 0.5 OR conflicting OR status = 'needs_review' THEN 'needs_review' ELSE 'explained' END"


def records(spark, d):
    i = F.col("event_id")
    source = F.struct(F.lit("t").alias("title"), F.lit("https://example.org/a").alias("url"), F.lit("example.org").alias("publisher"), F.lit("2020-01-01").cast("date").alias("published"))
    reason = F.element_at(F.array(*map(F.lit, ("not_in_search_results", "no_page_age", "outside_window"))), (i % 3 + 1).cast("int"))
    return table(spark, d, "events").select(
        F.concat(F.lit("e"), i).alias("episode_id"), i,
        F.when(i % 5 == 0, "unexplained").when(i % 5 == 1, "needs_review").otherwise("explained").alias("status"),
        (i % 100).cast("double").__truediv__(100).alias("confidence"), F.array_repeat(source, (i % 4).cast("int")).alias("sources"),
        (i % 7 == 0).alias("conflicting_sources"), (i % 11 == 0).alias("reviewed"), F.lit(False).alias("rejected"),
        F.when(i % 3 == 0, "null").when(i % 3 == 1, "search").alias("provider"), F.when(i % 2 == 0, "v1").otherwise("v0").alias("prompt_version"), F.when(i % 2 == 0, "base").otherwise("large").alias("model"),
        F.concat(F.lit("h"), i).alias("headline"), F.lit("s").alias("summary"), F.when(i % 10 == 3, "rejected").otherwise("other").alias("category"), F.lit("US").alias("region"),
        F.array(F.lit("d")).alias("drivers"),
        F.array_repeat(F.struct(F.lit("https://example.org/b").alias("url"), reason.alias("reason")), (i % 3).cast("int")).alias("dropped_sources"),
        F.array_repeat(F.when(i % 2 == 0, "end_turn").otherwise("pause_turn"), (1 + i % 2).cast("int")).alias("stop_reasons"),
        F.struct((i % 5000).cast("long").alias("input_tokens"), (i % 700).cast("long").alias("output_tokens"), (i % 4).cast("long").alias("web_search_requests")).alias("usage"),
    )


@query("f21_status_rules", f"WITH {REC} SELECT episode_id, {RULED} status FROM rec")
def status_rules(spark, d):
    return E.with_status(records(spark, d)).select("episode_id", "status")


@query("f22_record_faults", f"WITH {REC} SELECT episode_id, 'headline too long' fault FROM rec WHERE length(headline) > 4 UNION ALL SELECT episode_id, 'unknown category' FROM rec WHERE category = 'rejected' UNION ALL SELECT episode_id, 'unknown region' FROM rec WHERE event_id % 17 = 0 UNION ALL SELECT episode_id, 'confidence outside 0 to 1' FROM rec WHERE event_id % 19 = 0")
def record_faults(spark, d):
    odd = records(spark, d).withColumns({"region": F.when(F.col("event_id") % 17 != 0, F.col("region")), "confidence": F.when(F.col("event_id") % 19 == 0, 1.5).otherwise(F.col("confidence"))})
    return E.record_faults(odd, replace(SETTINGS, headline_max=4))


_OV = """ov AS (SELECT 'e' || event_id episode_id, 1 place, CASE event_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'edit' END action, event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'e' || event_id, 2, 'edit', event_id FROM events WHERE event_id % 12 = 0),
lo AS (SELECT episode_id, arg_max(action, place) action, max(event_id) id FROM ov GROUP BY 1),
ef AS (SELECT rec.*, lo.action, CASE WHEN action = 'reject' THEN 'unexplained' WHEN action = 'accept' AND status = 'needs_review' THEN 'explained' WHEN action = 'edit' AND id % 4 = 0 THEN 'explained' ELSE status END st FROM rec LEFT JOIN lo ON lo.episode_id = rec.episode_id)"""


def overrides(spark, d):
    i = F.col("event_id")
    fields = F.map_filter(F.create_map(F.lit("headline"), F.concat(F.lit("edited "), i), F.lit("status"), F.when(i % 4 == 0, "explained"), F.lit("drivers"), F.lit('["x","y"]')), lambda k, v: v.isNotNull())
    base = table(spark, d, "events")
    row = lambda place, action: (F.concat(F.lit("e"), i).alias("episode_id"), F.lit(place).alias("place"), action.alias("action"), F.when(action == "edit", fields).alias("fields"), F.lit("2024-01-01T00:00:00Z").alias("reviewed_at"), F.lit("").alias("note"))
    first = base.filter("event_id % 2 = 0").select(*row(1, F.when(i % 3 == 0, "accept").when(i % 3 == 1, "reject").otherwise("edit")))
    return first.unionByName(base.filter("event_id % 12 = 0").select(*row(2, F.lit("edit"))))


@query("f20_effective_records", f"WITH {REC}, {_OV} SELECT episode_id, CASE WHEN action IS NULL THEN st WHEN n_sources = 0 OR st = 'unexplained' THEN 'unexplained' ELSE st END status, CASE WHEN action = 'edit' THEN 'edited ' || event_id ELSE headline END headline, CASE WHEN action = 'edit' THEN 'x,y' ELSE 'd' END drivers, coalesce(action = 'reject', FALSE) rejected, reviewed OR action IS NOT NULL reviewed, action override_action FROM ef")
def effective(spark, d):
    e = E.apply_overrides(records(spark, d), overrides(spark, d))
    return e.select("episode_id", "status", "headline", F.array_join("drivers", ",").alias("drivers"), "rejected", "reviewed", "override_action")


@query("f22_override_faults", "SELECT 'e' || event_id episode_id, CASE WHEN event_id % 3 = 0 THEN 'not editable: confidence,sources' WHEN event_id % 3 = 1 THEN 'fields without edit' ELSE 'unknown region' END fault FROM events WHERE event_id % 3 < 2 OR event_id % 5 = 0")
def override_faults(spark, d):
    i = F.col("event_id")
    bad = F.when(i % 3 == 0, F.create_map(F.lit("sources"), F.lit("x"), F.lit("confidence"), F.lit("1"))).when((i % 3 == 2) & (i % 5 == 0), F.create_map(F.lit("region"), F.lit("Mars"))).otherwise(F.create_map(F.lit("headline"), F.lit("x")))
    o = table(spark, d, "events").select(F.concat(F.lit("e"), i).alias("episode_id"), F.when(i % 3 == 1, "accept").otherwise("edit").alias("action"), bad.alias("fields"))
    return E.override_faults(o)


@query("c19_upsert", "SELECT 'e' || event_id episode_id, CASE WHEN event_id % 5 = 0 THEN 'new' ELSE 'old' END note FROM events UNION ALL SELECT 'n' || event_id, 'new' FROM events WHERE event_id % 5 = 0")
def upsert(spark, d):
    ids = table(spark, d, "events").select("event_id")
    old = ids.select(F.concat(F.lit("e"), "event_id").alias("episode_id"), F.lit("old").alias("note"))
    fifth = ids.filter("event_id % 5 = 0")
    new = fifth.select(F.explode(F.array(F.concat(F.lit("e"), "event_id"), F.concat(F.lit("n"), "event_id"))).alias("episode_id"), F.lit("new").alias("note"))
    return E.upsert(old, new)


@query("p9_current_records", f"WITH {REC} SELECT episode_id FROM rec WHERE provider IS DISTINCT FROM 'null' AND prompt_version = 'v1'")
def current(spark, d):
    return records(spark, d).filter(E.is_current()).select("episode_id")


_EPS = "eps AS (SELECT 'e' || event_id episode_id, CAST(ts AS DATE) start_date, CASE WHEN event_id % 9 = 0 THEN 'open' ELSE 'closed' END status FROM events)"


def episodes(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(F.concat(F.lit("e"), i).alias("episode_id"), F.to_date("ts").alias("start_date"), F.when(i % 9 == 0, "open").otherwise("closed").alias("status"))


@query("j9_pending", f"WITH {REC}, {_EPS} SELECT * FROM eps WHERE status = 'closed' AND episode_id NOT IN (SELECT episode_id FROM rec WHERE provider IS DISTINCT FROM 'null' AND prompt_version = 'v1') ORDER BY start_date, episode_id LIMIT 50")
def pending(spark, d):
    return E.pending(episodes(spark, d), records(spark, d), limit=50)


@query("j10_to_escalate", f"WITH {REC}, {_EPS} SELECT * FROM eps WHERE episode_id IN (SELECT episode_id FROM rec WHERE status = 'needs_review' AND model <> 'large')")
def escalate(spark, d):
    return E.to_escalate(records(spark, d), episodes(spark, d), "large")


@query("p10_review_queue", f"WITH {REC} SELECT episode_id, status FROM rec WHERE status = 'needs_review' AND event_id % 2 <> 0")
def review_queue(spark, d):
    return E.review_queue(records(spark, d), overrides(spark, d)).select("episode_id", "status")


_PRICES = [("base", 0.1, 0.5), ("large", 2.0, 10.0)]


def prices(spark):
    return spark.createDataFrame(_PRICES, "model string, input_usd double, output_usd double")


_COST = "CASE model WHEN 'base' THEN 0.1::DOUBLE ELSE 2.0::DOUBLE END * (event_id % 5000) / 1e6 + CASE model WHEN 'base' THEN 0.5::DOUBLE ELSE 10.0::DOUBLE END * (event_id % 700) / 1e6 + 10.0::DOUBLE * (event_id % 4) / 1000"


def _usage(spark, d):
    return records(spark, d).select("episode_id", "model", "usage.*")


@query("a25_cost", f"WITH {REC} SELECT episode_id, model, round({_COST}, 8) cost_usd FROM rec")
def cost(spark, d):
    return rounded(E.cost(_usage(spark, d), prices(spark)).select("episode_id", "model", "cost_usd"))


@query("a19_ledger_total", f"WITH {REC} SELECT round(sum({_COST}), 6) total_usd FROM rec")
def ledger_total(spark, d):
    return rounded(E.ledger_total(E.cost(_usage(spark, d), prices(spark))), 6)


_PENDING = """pe AS (SELECT count(*) n FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'))"""


@query("a26_estimate", f"WITH {_PENDING} SELECT model, n AS episodes, round(n * (10.0 * 1.5 / 1000 + 5000 * i / 1e6 + 500 * o / 1e6), 8) estimate_usd FROM pe, (VALUES ('base', 0.1::DOUBLE, 0.5::DOUBLE), ('large', 2.0::DOUBLE, 10.0::DOUBLE)) v(model, i, o)")
def estimate(spark, d):
    """For as many episodes as the table has users who bought something."""
    pending = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id").distinct()
    return rounded(E.estimate_for(prices(spark), pending))


@query("a20_record_tallies", f"""WITH {REC}, dr AS (SELECT unnest(range(event_id % 3)) k, CASE event_id % 3 WHEN 0 THEN 'not_in_search_results' WHEN 1 THEN 'no_page_age' ELSE 'outside_window' END reason FROM rec),
sr AS (SELECT unnest(range(1 + event_id % 2)) k, CASE WHEN event_id % 2 = 0 THEN 'end_turn' ELSE 'pause_turn' END stop FROM rec)
SELECT 'status' AS dimension, status AS value, count(*) n FROM rec GROUP BY 2 UNION ALL SELECT 'model', model, count(*) FROM rec GROUP BY 2 UNION ALL SELECT 'dropped', reason, count(*) FROM dr GROUP BY 2 UNION ALL SELECT 'stop', stop, count(*) FROM sr GROUP BY 2""")
def record_tallies(spark, d):
    return reports.record_tallies(records(spark, d))


@query("a20_search_usage", "SELECT CAST(sum(event_id % 4) AS BIGINT) total, max(event_id % 4) most FROM events")
def search_usage(spark, d):
    return reports.search_usage(records(spark, d))


@query("a21_drop_reasons", "SELECT 'e' || event_id episode_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'no_page_age' ELSE 'outside_window' END reasons FROM events")
def drop_reasons(spark, d):
    return reports.drop_reasons(records(spark, d))


@query("a20_missing_records", f"WITH {REC}, {_EPS} SELECT episode_id FROM eps WHERE status = 'closed' AND episode_id NOT IN (SELECT episode_id FROM rec WHERE event_id % 4 = 0)")
def missing(spark, d):
    return reports.missing_records(episodes(spark, d), records(spark, d).filter("event_id % 4 = 0"))


# answers of a search tool made from the pages: each found by a search of its own
_AGE = "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '3 days ago' WHEN 2 THEN 'April ' || (1 + page_id % 28) || ', 2020' WHEN 3 THEN 'Updated 2020-04-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') || ' 10:00' ELSE (1 + page_id % 28) || ' May 2020' END"
SRC = f"""pg AS (SELECT page_id, url, {_AGE} age, CASE page_id % 5 WHEN 2 THEN make_date(2020, 4, CAST(1 + page_id % 28 AS INTEGER)) WHEN 3 THEN make_date(2020, 4, CAST(1 + page_id % 28 AS INTEGER)) WHEN 4 THEN make_date(2020, 5, CAST(1 + page_id % 28 AS INTEGER)) END published FROM pages)"""


def _age():
    i, day = F.col("page_id"), 1 + F.col("page_id") % 28
    return F.when(i % 5 == 1, "3 days ago").when(i % 5 == 2, F.concat(F.lit("April "), day, F.lit(", 2020"))).when(i % 5 == 3, F.concat(F.lit("Updated 2020-04-"), F.lpad(day.cast("string"), 2, "0"), F.lit(" 10:00"))).when(i % 5 == 4, F.concat(day, F.lit(" May 2020")))


def _responses(spark, d):
    i = F.col("page_id")
    item = F.to_json(F.array(F.struct(F.lit("web_search_result").alias("type"), "url", F.concat(F.lit("title "), i).alias("title"), _age().alias("page_age"))))
    block = F.struct(F.lit("web_search_tool_result").alias("type"), item.alias("content"))
    other = F.struct(F.lit("text").alias("type"), F.lit("prose").alias("content"))
    broken = F.struct(F.lit("web_search_tool_result").alias("type"), F.lit('{"type":"web_search_tool_result_error"}').alias("content"))
    blocks = F.to_json(F.array(other, broken, F.when(i % 6 != 0, block).otherwise(other)))
    return table(spark, d, "pages").select(F.concat(F.lit("e"), i).alias("episode_id"), blocks.alias("blocks"))


@query("s18_search_results", f"WITH {SRC} SELECT 'e' || page_id episode_id, url, 'title ' || page_id title, age page_age FROM pg WHERE page_id % 6 <> 0")
def search_results(spark, d):
    return E.search_results(_responses(spark, d))


@query("f17_page_date", f"WITH {SRC} SELECT page_id, published FROM pg")
def page_date(spark, d):
    return table(spark, d, "pages").select("page_id", text.page_date(_age()).alias("published"))


@query("f18_publisher", "SELECT page_id, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '^.*@', ''), ':.*$', '')), '^www\\.', '') publisher FROM pages")
def publisher(spark, d):
    return table(spark, d, "pages").select("page_id", text.publisher(F.col("url")).alias("publisher"))


@query("f19_source_filter", f"""WITH {SRC} SELECT 'e' || page_id episode_id, url, CASE WHEN page_id % 6 = 0 THEN 'not_in_search_results' WHEN age IS NULL THEN 'no_page_age' WHEN published IS NULL THEN 'unparseable_page_age' WHEN published NOT BETWEEN DATE '2020-04-05' AND DATE '2020-05-10' THEN 'outside_window' END reason FROM pg""")
def source_filter(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("e"), "page_id").alias("episode_id"), "url")
    claimed = p.withColumn("place", F.lit(1)).unionByName(p.withColumn("place", F.lit(2)))
    windows = p.select("episode_id", F.lit("2020-04-05").cast("date").alias("search_from"), F.lit("2020-05-10").cast("date").alias("search_to"))
    return E.check_sources(claimed, E.search_results(_responses(spark, d)), windows).select("episode_id", "url", "reason")


_KEPT = "page_id % 6 <> 0 AND published BETWEEN DATE '2020-04-05' AND DATE '2020-05-10'"


@query("c16_answers", f"""WITH {SRC}, k AS (SELECT *, coalesce({_KEPT}, FALSE) kept, CAST(page_id % 10 AS DOUBLE) / 10 confidence FROM pg)
SELECT 'e' || page_id episode_id, CASE WHEN NOT kept THEN 'unexplained' WHEN confidence < 0.5 THEN 'needs_review' ELSE 'explained' END status,
CASE WHEN page_id % 11 = 0 THEN 'stopped by max_tokens' WHEN page_id % 13 = 0 THEN 'missing: summary' WHEN page_id % 7 = 0 THEN 'unknown category' END fault, CAST(kept AS INTEGER) n_sources,
CASE WHEN kept THEN '' WHEN page_id % 6 = 0 THEN 'not_in_search_results' WHEN age IS NULL THEN 'no_page_age' WHEN published IS NULL THEN 'unparseable_page_age' ELSE 'outside_window' END dropped,
CASE WHEN page_id % 11 = 0 THEN 'pause_turn|max_tokens' ELSE 'pause_turn|end_turn' END stop_reasons, 2 * page_id input_tokens, CAST(1 AS BIGINT) web_search_requests FROM k""")
def answers(spark, d):
    """Two replies for each page: one that searches and pauses, one with the answer."""
    i = F.col("page_id")
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit("e"), i).alias("episode_id"))
    said = F.to_json(F.struct(
        F.lit("explained").alias("status"), F.concat(F.lit("h"), i).alias("headline"), F.when(i % 13 != 0, "s").alias("summary"), F.when(i % 7 == 0, "odd").otherwise("other").alias("category"), F.lit("US").alias("region"),
        F.array(F.lit("d")).alias("drivers"), F.array(F.struct("url", F.lit("claimed").alias("title"))).alias("sources"), ((i % 10).cast("double") / 10).alias("confidence"), F.lit(False).alias("conflicting_sources"),
    ))
    text = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.lit("thinking").alias("text")), F.struct(F.lit("text").alias("type"), said.alias("text"))))
    counts = lambda searches: (i.alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(searches).cast("long").alias("web_search_requests"))
    first = _responses(spark, d).join(pages, "episode_id").select("episode_id", F.lit(0).alias("place"), F.lit("pause_turn").alias("stop_reason"), F.col("blocks").alias("content"), *counts(1))
    second = pages.select("episode_id", F.lit(1).alias("place"), F.when(i % 11 == 0, "max_tokens").otherwise("end_turn").alias("stop_reason"), text.alias("content"), *counts(0))
    e = pages.select("episode_id", F.lit("2020-04-05").cast("date").alias("search_from"), F.lit("2020-05-10").cast("date").alias("search_to"), F.lit("scheduled").alias("catalyst"))
    a = E.answers(first.unionByName(second), e)
    return a.select("episode_id", "status", "fault", F.size("sources").alias("n_sources"), F.array_join(F.transform("dropped_sources", lambda x: x["reason"]), "|").alias("dropped"), F.array_join("stop_reasons", "|").alias("stop_reasons"), "usage.input_tokens", "usage.web_search_requests")


@query("p13_narrowed", f"WITH {_EPS} SELECT episode_id, start_date, status, '' scheduled, CASE WHEN CAST(episode_id[2:] AS BIGINT) % 2 = 0 THEN 'FOMC' ELSE '' END unscheduled, CAST(episode_id[2:] AS DOUBLE) move_pct FROM eps")
def narrowed(spark, d):
    e, i = episodes(spark, d), F.expr("bigint(substr(episode_id, 2))")
    none = F.lit(None)
    wide = e.withColumns({
        **{c: F.col("start_date").cast("timestamp") for c in ("end_date", "anchor_date", "search_from", "search_to")}, "start_date": F.col("start_date").cast("timestamp"), "direction": F.lit("up"), "trigger": F.lit("gap"),
        "move_pct": i, "scheduled_releases": none.cast("array<string>"), "unscheduled_releases": F.when(i % 2 == 0, F.array(F.lit("FOMC"))), "catalyst": F.lit("surprise"), "more": F.lit(1),
    })
    n = E.narrowed(wide)
    return n.select("episode_id", "start_date", "status", F.array_join("scheduled_releases", "|").alias("scheduled"), F.array_join("unscheduled_releases", "|").alias("unscheduled"), "move_pct")


@query("p14_records", f"WITH {REC}, {_EPS} SELECT rec.episode_id, {RULED} status, start_date search_from, 'v1' prompt_version, 'then' enriched_at FROM rec JOIN (SELECT episode_id, start_date FROM eps) e ON e.episode_id = rec.episode_id")
def to_records(spark, d):
    e = episodes(spark, d).select("episode_id", F.col("start_date").alias("search_from"), F.col("start_date").alias("search_to"))
    return E.to_records(records(spark, d).drop("prompt_version"), e, "then").select("episode_id", "status", "search_from", "prompt_version", "enriched_at")


@query("l3_record_table", f"WITH {REC}, i AS (SELECT 'e' || event_id episode_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'none') SELECT i.episode_id, rec.episode_id IS NOT NULL found, status, confidence, CAST(coalesce(n_sources, 0) AS INTEGER) kept_sources, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'no_page_age' WHEN 2 THEN 'outside_window' END dropped_reasons, coalesce(event_id % 4, 0) searches, headline FROM i LEFT JOIN rec ON rec.episode_id = i.episode_id")
def record_table(spark, d):
    ids = table(spark, d, "events").filter("event_id % 2 = 0").select(F.concat(F.lit("e"), "event_id").alias("episode_id")).unionByName(spark.createDataFrame([("none",)], "episode_id string"))
    return reports.record_table(records(spark, d).withColumn("cost_usd", F.lit(0.0)), ids).drop("cost_usd")


@query("f23_safe_urls", "SELECT page_id, starts_with(url, 'https://') AND NOT contains(lower(url), 'api_key') safe FROM pages")
def safe_urls(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_url(F.col("url")).alias("safe"))


#: The entities that stand in the pages; an ampersand's comes last, so that nothing is read twice.
_ENT = "regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


@query("s13_plain_text", f"SELECT page_id, regexp_replace({_ENT}, '[\\s\\x{{00A0}}]+', ' ', 'g') AS plain FROM pages")
def plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query("s16_month_numbers", "SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) m FROM orders")
def month_numbers(spark, d):
    name = F.date_format("o_orderdate", "MMMM")
    return table(spark, d, "orders").select("o_orderkey", text.month_number(F.when(F.col("o_orderkey") % 2 == 0, F.upper(name)).otherwise(F.substring(name, 1, 3))).alias("m"))


_PROMPTS = """SELECT 'e' || event_id episode_id, 'episode_id: e' || event_id || chr(10) || 'direction: up' || chr(10) || 'trigger: gap' || chr(10) || 'move_pct: ' || format('{:+.2f}', CAST(event_id % 200 - 100 AS DOUBLE) / 16) || '%' || chr(10)
|| 'start_date: ' || CAST(ts AS DATE) || chr(10) || 'end_date: ' || CAST(ts AS DATE) || chr(10) || 'anchor_date: ' || CAST(ts AS DATE) || chr(10) || 'search_from: ' || CAST(ts AS DATE) || chr(10) || 'search_to: ' || CAST(ts AS DATE) || chr(10)
|| 'scheduled_releases: ' || CASE WHEN event_id % 2 = 0 THEN 'CPI 2020-01-01, FOMC 2020-01-02' ELSE 'none' END || chr(10) || 'unscheduled_releases: none' || chr(10) || 'catalyst: ' || CASE WHEN event_id % 2 = 0 THEN 'scheduled' ELSE 'surprise' END || chr(10)
|| CASE WHEN event_id % 2 = 0 THEN 'A scheduled release lies in the window.' ELSE 'No scheduled release lies in the window.' END AS prompt FROM events"""


def _prompts(spark, d):
    i, day = F.col("event_id"), F.to_date("ts")
    none = F.array().cast("array<string>")
    e = table(spark, d, "events").select(
        F.concat(F.lit("e"), i).alias("episode_id"), F.lit("up").alias("direction"), F.lit("gap").alias("trigger"), ((i % 200 - 100).cast("double") / 1600).alias("move_pct"),
        *[day.alias(c) for c in ("start_date", "end_date", "anchor_date", "search_from", "search_to")],
        F.when(i % 2 == 0, F.array(F.lit("CPI 2020-01-01"), F.lit("FOMC 2020-01-02"))).otherwise(none).alias("scheduled_releases"), none.alias("unscheduled_releases"),
        F.when(i % 2 == 0, "scheduled").otherwise("surprise").alias("catalyst"),
    )
    return E.prompts(e)


@query("f24_prompts", _PROMPTS)
def prompts(spark, d):
    return _prompts(spark, d).select("episode_id", "prompt")


@query("f25_fingerprints", f"SELECT episode_id, sha256(prompt) digest, 'v1' prompt_version, '{E.PINNED['v1']}' fingerprint FROM ({_PROMPTS})")
def fingerprints(spark, d):
    return _prompts(spark, d).select("episode_id", "digest", "prompt_version", "fingerprint")


@query("c17_null_explanations", f"WITH {_EPS} SELECT episode_id, 'unexplained' status, start_date >= DATE '2020-01-01' scheduled, 'null' provider, 0.0::DOUBLE confidence FROM eps")
def null_explanations(spark, d):
    e = episodes(spark, d).withColumn("catalyst", F.when(F.col("start_date") >= F.lit("2020-01-01").cast("date"), "scheduled").otherwise("surprise"))
    return E.null_explanations(e).select("episode_id", "status", "scheduled", "provider", "confidence")


@query("k10_leak_scan", "SELECT bool_or(contains(lower(text), 'apache license') OR contains(lower(text), 'sk-secret')) leaked FROM documents")
def leak_scan(spark, d):
    return E.leaks(table(spark, d, "documents").select("doc_id", "text"), ["Apache License", "SK-SECRET"])


@query("k11_sanitised", "SELECT event_id, '{\"a\":{\"title\":\"t' || event_id || '\"},\"b\":[{\"x\":1}]}' AS json FROM events")
def sanitised(spark, d):
    i = F.col("event_id")
    raw = F.concat(F.lit('{"a":{"encrypted_content":"q\\"z","title":"t'), i, F.lit('","cited_text":null},"b":[{"x":1,"encrypted_index":["e",{"y":2}]}], "cited_text": {"z": [1]}}'))
    return table(spark, d, "events").select("event_id", E.without_keys(raw).alias("json"))


@query("p12_display", "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE format('{:.1f}%', CAST(event_id % 64 AS DOUBLE) / 64 * 100) END shown FROM events")
def display(spark, d):
    x = F.when(F.col("event_id") % 10 != 0, (F.col("event_id") % 64).cast("double") / 64)
    return table(spark, d, "events").select("event_id", text.shown(x, "pct").alias("shown"))


@query("f33_trimmed_lists", "SELECT event_id, 'a|b ' || event_id joined FROM events")
def trimmed(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(text.trimmed_list(F.concat(F.lit(" a ,b "), "event_id", F.lit(",, "))), "|").alias("joined"))


@query("builtin_star_join", "SELECT n_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def star_join(spark, d):
    """Built-in, absent in the reference: scans, joins and aggregation alone."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
