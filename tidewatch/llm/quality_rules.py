"""Quality rules: a threshold table compiled into one projection.

Every measure is a Spark expression over the whole text and every rule a row (measure, relation, bound), so a
document's verdict is one conjunction that runs where the text is scanned: no shuffle, no user function.

Words are longest runs of characters other than ASCII white space, lines are what stands between line feeds, a
word has a letter if it holds one of any script.  A null or empty text has no words and fails the base rules.
Ratios of nothing are 0.  Rows are judged one by one, so repeated rows get equal verdicts; an empty table gives
an empty table; other columns of the table don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, named, whole_rows

#: Characters counted as symbols.  Fixed values.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.  Fixed values.
STOP_WORDS = (
    "the be to of and that have with in is it for on as are this by from or an was which not "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er aus bei sind "
    "le la les de des du et en un une que qui dans pour par sur est pas au avec il elle ce "
    "el la los las de del y en un una que por con para se no es al lo como más su"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if measure relation bound holds; relation is ">=" or "<="."""

    measure: str
    relation: str
    bound: float


#: The production thresholds.
RULES = (
    Rule("mean_word_length", ">=", 2.0),
    Rule("mean_word_length", "<=", 15.0),
    Rule("symbol_ratio", "<=", 0.2),
    Rule("stop_word_ratio", ">=", 0.05),
    Rule("letter_word_ratio", ">=", 0.5),
    Rule("dup_line_ratio", "<=", 0.5),
    Rule("bullet_line_ratio", "<=", 0.9),
    Rule("ellipsis_line_ratio", "<=", 0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _shifted(xs: Column, by: int) -> Column:
    return F.slice(xs, F.lit(1 + by), F.greatest(F.size(xs) - by, F.lit(0)))


def repeated_words(hashes: Column) -> Column:
    """Words in windows of three that occur twice or more; hashes: of each word, as an array column of its own.

    The windows are sorted by their 64-bit hash with their place, neighbours of equal hash are repeats, and the
    words they cover are counted from the sorted places: linear but for two sorts, whatever repeats how often.  Words
    aren't compared, so two different windows of equal 64-bit hash, once in some 10^9 texts of 100,000 words, would count.
    """
    triples = F.slice(F.arrays_zip(hashes.alias("a"), _shifted(hashes, 1).alias("b"), _shifted(hashes, 2).alias("c")), F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0)))
    windows = F.sort_array(F.transform(triples, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i"))))
    return windows


def _repeat_places(windows: Column) -> Column:
    pairs = F.zip_with(windows, _shifted(windows, 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def _covered(places: Column) -> Column:
    steps = F.zip_with(places, _shifted(places, 1), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("long")


def measure(docs: DataFrame, keep: Column, text: Column) -> DataFrame:
    """keep (as "keep") and every measure of text; stages are apart so that each array is built once."""
    blank_free = F.translate(F.col("t"), " \t\n\x0b\x0c\r", "")
    a = docs.select(keep.alias("keep"), F.coalesce(text.cast("string"), F.lit("")).alias("t"))
    b = a.select(
        "keep",
        F.array_remove(F.split("t", BLANKS), "").alias("w"),
        F.split("t", "\n").alias("lines"),
        F.length(blank_free).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate(F.col("t"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    line = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    c = b.select(
        "keep", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).alias("n_stop"),
        F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).alias("n_letter_words"),
        line.alias("lines"),
    )
    d = c.select(
        "keep", "word_chars", "n_symbols", "n_words", "n_stop", "n_letter_words",
        repeated_words(F.col("hashes")).alias("windows"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).alias("n_bullets"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).alias("n_ellipses"),
    )
    e = d.withColumn("places", _repeat_places(F.col("windows"))).drop("windows")
    n, lines = F.col("n_words"), F.col("n_lines")
    return e.select(
        "keep", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        _covered(F.col("places")).alias("n_repeat_words"),
        _ratio(F.col("word_chars"), n).alias("mean_word_length"),
        _ratio(F.col("n_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("n_stop"), n).alias("stop_word_ratio"),
        _ratio(F.col("n_letter_words"), n).alias("letter_word_ratio"),
        _ratio(F.col("n_dup_lines"), lines).alias("dup_line_ratio"),
        _ratio(F.col("n_bullets"), lines).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipses"), lines).alias("ellipsis_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The conjunction of all rules."""
    out = F.lit(True)
    for r in rules:
        c = F.col(r.measure)
        out = out & ((c >= F.lit(r.bound)) if r.relation == ">=" else (c <= F.lit(r.bound)))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, keep: Column, text: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep, all measures, base_failed and kept."""
    return measure(docs, keep, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that are kept, columns as they are."""
    judged = judge(docs, whole_rows(docs), named(docs, "text"), rules)
    # Catalyst would write the measures out in a filter below the stages, each array many times over; it moves no
    # filter past a column of this kind
    return judged.withColumn("place", F.monotonically_increasing_id()).filter("kept AND place >= 0").select("keep.*")
