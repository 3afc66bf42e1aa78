"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, crf_language, curriculum_mix, forced_bpe, importance_resampling, license_scan, permutation_index, quality_rules, quotation_linking, simhash_slices, temporal_url_filter, token_alignment, token_files


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentences", " ").alias("sentences"), F.array_join("licences", " ").alias("licences"), "n_sentences", "n_unknown")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = permutation_index.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table holds no quotes: the chats are written as mail first, in which every reply quotes two turns, one in the other."""
    return quotation_linking.conversations(quotation_linking.as_mail(_table(spark, sf_dir, "conversations")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    told = crf_language.predict(docs, crf_language.train(docs))
    return told.select("row.doc_id", crf_language.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forced_bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, docs["doc_id"], docs["text"])
    return judged.select(F.col("keep").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: A dated list: pattern, date, action.
URL_LIST = (
    ("casino-win.example.com", "2024-01-15", "block"), ("casino-win.example.com", "2024-09-01", "drop"),
    ("free-bets.example.com", "2024-03-01", "block"),
    ("cheap-pills.example.com", "2024-02-01", "block"), ("cheap-pills.example.com", "2024-06-01", "drop"), ("cheap-pills.example.com", "2024-10-01", "block"),
    ("spam-farm.example.com", "2023-12-01", "block"), ("www.spam-farm.example.com", "2024-08-01", "allow"), ("www.spam-farm.example.com", "2024-08-15", "drop"),
    ("ads-track.example.com", "2024-05-01", "block"), ("m.ads-track.example.com", "2024-07-01", "allow"),
    ("example.org", "2024-04-01", "block"), ("example.org", "2024-04-15", "drop"), ("blog.ththth.example.org", "2024-04-05", "allow"),
    ("tionsh.example.net", "2024-11-01", "block"), ("tionsh.example.net", "2024-11-20", "allow"),
)


def _spelling():
    """By page_id: as it is, with a user, with a port, with signs that a strict parser refuses, with upper case and a dot after the host, behind a tab and with a %-sign, with backslashes."""
    n, cut = F.col("page_id") % 7, r"^([a-z]+://)([^/?#]+)"
    put = lambda to: F.regexp_replace("url", cut, to)
    upper = F.concat(F.regexp_extract("url", cut, 1), F.upper(F.regexp_extract("url", cut, 2)), F.lit("."), F.regexp_replace("url", cut, ""))
    odd = F.concat(F.lit("\t "), F.regexp_extract("url", cut, 1), F.replace(F.regexp_extract("url", cut, 2), F.lit("."), F.lit("%2e")), F.regexp_replace("url", cut, ""), F.lit("\n"))
    return F.when(n == 5, odd).when(n == 6, F.concat(F.regexp_extract("url", cut, 1), F.regexp_extract("url", cut, 2), F.lit("\\@good.example.net/"))).when(n == 1, put("$1crawler:x@$2")).when(n == 2, put("$1$2:8080")).when(n == 3, F.concat("url", F.lit("|a b%zz"))).when(n == 4, upper).otherwise(F.col("url"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages hold no time of capture: each gets a day of 2024 from its id, and its URL one of seven spellings that captures have."""
    pages = _table(spark, sf_dir, "pages").select("page_id", _spelling().alias("url"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int"))
    entries = spark.createDataFrame(list(URL_LIST), "pattern string, since string, action string").withColumn("since", F.col("since").cast("date"))
    return temporal_url_filter.judge(pages.withColumn("day", day), entries, "page_id", "url", "day")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_slices.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum_mix.mix(_table(spark, sf_dir, "documents"))
    mixed = mixed.withColumn("position", F.try_element_at("positions", F.lit(1)))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict:
    return {
        "op1_license_sentences": op1,
        "op2_permutation_index": op2,
        "op3_quotation_linking": op3,
        "op4_crf_language": op4,
        "op5_forced_boundary_bpe": op5,
        "op6_quality_rules": op6,
        "op7_temporal_url_filter": op7,
        "op8_token_files": op8,
        "op9_simhash_slices": op9,
        "op10_curriculum_mix": op10,
        "op11_token_alignment": op11,
        "op12_importance_resampling": op12,
        "op13_best_fit_packing": op13,
    }


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
_RULES = " AND ".join(f"{r.measure} {r.relation} {r.bound}" for r in quality_rules.RULES)

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls FROM d),
u AS (SELECT rid, unnest(ws) x, generate_subscripts(ws, 1) i FROM w),
v AS (SELECT rid, i, x, lead(x) OVER o y, lead(x, 2) OVER o z FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) n FROM v WHERE z IS NOT NULL),
c AS (SELECT rid, count(DISTINCT i + k) n_repeat_words FROM r, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY 1),
m AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) word_chars,
             CAST(length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS BIGINT) n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) n_repeat_words,
             CAST(len(ls) AS BIGINT) n_lines,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) n_stop,
             len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) n_letter,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) n_bullet,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) n_dots
      FROM w LEFT JOIN c ON w.rid = c.rid),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END mean_word_length,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END stop_word_ratio,
             CASE WHEN n_words > 0 THEN n_letter / n_words ELSE 0 END letter_word_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END dup_line_ratio,
             CASE WHEN n_lines > 0 THEN n_bullet / n_lines ELSE 0 END bullet_line_ratio,
             CASE WHEN n_lines > 0 THEN n_dots / n_lines ELSE 0 END ellipsis_line_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_RULES} kept FROM q
"""

_LIST = ", ".join(f"('{p}', DATE '{d}', '{a}')" for p, d, a in URL_LIST)

OP7_SQL = rf"""
WITH l(pattern, since, action) AS (VALUES {_LIST}),
i AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) until FROM l),
u AS (SELECT page_id, CASE page_id % 7 WHEN 5 THEN chr(9) || ' ' || regexp_extract(url, '^([a-z]+://)([^/?#]+)', 1) || replace(regexp_extract(url, '^([a-z]+://)([^/?#]+)', 2), '.', '%2e') || regexp_replace(url, '^([a-z]+://)([^/?#]+)', '') || chr(10)
             WHEN 6 THEN regexp_extract(url, '^([a-z]+://)([^/?#]+)', 1) || regexp_extract(url, '^([a-z]+://)([^/?#]+)', 2) || '\@good.example.net/' WHEN 1 THEN regexp_replace(url, '^([a-z]+://)([^/?#]+)', '\1crawler:x@\2') WHEN 2 THEN regexp_replace(url, '^([a-z]+://)([^/?#]+)', '\1\2:8080')
             WHEN 3 THEN url || '|a b%zz' WHEN 4 THEN regexp_extract(url, '^([a-z]+://)([^/?#]+)', 1) || upper(regexp_extract(url, '^([a-z]+://)([^/?#]+)', 2)) || '.' || regexp_replace(url, '^([a-z]+://)([^/?#]+)', '') ELSE url END url FROM pages),
p AS (SELECT page_id, nullif(rtrim(lower(trim(url_decode(replace(regexp_extract(replace(trim(url, ' ' || chr(9) || chr(10)), '\', '/'), '{temporal_url_filter.HOST}', 1), '+', '%2B')))), '.'), '') host,
             DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) fetched FROM u),
m AS (SELECT page_id, pattern, action, since, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC) r
      FROM p JOIN i ON (host = pattern OR ends_with(host, '.' || pattern)) AND fetched >= since AND (until IS NULL OR fetched < until) AND action <> 'drop')
SELECT p.page_id, host, fetched, pattern, action, since, host IS NOT NULL AND coalesce(action <> 'block', TRUE) kept
FROM p LEFT JOIN m ON p.page_id = m.page_id AND r = 1
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'z') k, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) p,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY k) - 1 turn FROM s),
w AS (SELECT *, CAST(CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) weight, CAST(2 AS DOUBLE) * source_size most FROM n),
b AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () total, sum(weight) OVER () all_weight,
             coalesce(sum(most) OVER o, 0.0::DOUBLE) most_before, coalesce(sum(weight) OVER o, 0.0::DOUBLE) weight_before
      FROM w WINDOW o AS (ORDER BY most / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most / weight * (all_weight - weight_before) + most_before <= total AS is_full FROM b),
g AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0.0::DOUBLE) tf, coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0.0::DOUBLE) wf FROM f),
t AS (SELECT k, source_size, turn, CASE WHEN is_full THEN most ELSE least(most, weight * ((total - tf) / (all_weight - wf))) END target FROM g),
e AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.turn,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY p, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) start,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END whole
      FROM d JOIN t ON d.k = t.k),
l AS (SELECT *, least(greatest(CAST(round(target - whole * source_size) AS BIGINT) - start, 0), size) last FROM e),
x AS (SELECT *, CASE WHEN size > 0 AND whole + (last > 0)::BIGINT > 0 THEN start / target END u FROM l)
SELECT doc_id, size, source_size, target, CAST(whole * size + last AS BIGINT) taken,
       CASE WHEN u IS NULL THEN NULL
            WHEN turn % 3 = 0 THEN 0.0::DOUBLE + 2.0::DOUBLE * (u * 1.0::DOUBLE) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * (u * 1.0::DOUBLE)))
            WHEN turn % 3 = 1 THEN 2.0::DOUBLE * u / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
            WHEN u * 0.9375::DOUBLE < 0.5625::DOUBLE THEN 2.0::DOUBLE * (u * 0.9375::DOUBLE) / (1.5::DOUBLE + sqrt(2.25::DOUBLE + -3.0::DOUBLE * (u * 0.9375::DOUBLE)))
            ELSE 0.5::DOUBLE + 2.0::DOUBLE * (u * 0.9375::DOUBLE - 0.5625::DOUBLE) / (0.75::DOUBLE + sqrt(0.5625::DOUBLE)) END AS position
FROM x
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": OP6_SQL, "op7_temporal_url_filter": OP7_SQL, "op10_curriculum_mix": OP10_SQL}
