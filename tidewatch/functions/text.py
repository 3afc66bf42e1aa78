"""Text, URL and date helpers as column expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of HTML's entities, as the standard library lists them; some may stand without their semicolon.
_NAMED = {k.removesuffix(";"): v for k, v in sorted(html5.items())}
_LOOSE = sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True)
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31}(?=;)|" + "|".join(_LOOSE) + r");?"
#: Numbers that stand for Windows' characters, from 128.  Fixed values.
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace").replace("\ufffd", "\x00")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def unescaped(text: Column) -> Column:
    """Entities as characters, each read once, from left to right; a name that is no entity stays as it is."""
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in _NAMED.items())), F.lit("\x01"), F.lit("\x02"))
    windows = F.split(F.lit("\x01".join(c if c != "\x00" else chr(0x80 + k) for k, c in enumerate(_WINDOWS))), "\x01")

    def character(found: Column) -> Column:
        name = F.rtrim(F.substring(found, 2, 64), F.lit(";"))
        hexed = F.lower(F.substring(name, 2, 1)) == "x"
        code = F.when(hexed, F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("long")
        bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        number = F.when(bad, "\ufffd").when(code.between(0x80, 0x9F), F.get(windows, (code - 0x80).cast("int"))).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(name.startswith("#"), number).otherwise(F.coalesce(F.try_element_at(names, name), found))

    between, found = F.split(text, _ENTITY), F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), 0), character)
    return F.when(text.contains("&"), F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """Tags become spaces, entities characters, runs of white space one space."""
    return F.regexp_replace(unescaped(F.regexp_replace(html, "<[^>]+>", " ")), r"[\s\u00a0]+", " ")


def month_number(name: Column) -> Column:
    """1 to 12 from a full name or its first three letters, in any case; else null."""
    low, out = F.lower(name), None
    for i, m in enumerate(MONTHS, 1):
        hit = (low == m) | (low == m[:3])
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def publisher(url: Column) -> Column:
    """Lower-case host without user, port and leading www.; never fails."""
    rest = F.regexp_replace(url, r"^.*?://", "")
    host = F.split(rest, "/")[0]
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", "")
    return F.regexp_replace(F.lower(host), r"^www\.", "")


_DATE_LIKE = r"(\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|[A-Za-z]{3,9}\.? \d{1,2}(?:st|nd|rd|th)?,? \d{4}|\d{1,2}(?:st|nd|rd|th)? [A-Za-z]{3,9}\.?,? \d{4})"


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_WORD = r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
_YEAR_WORD = r"(?<![\d:./])((?:19|20)\d{2})(?![\d:/]|\.\d)"
#: A number that may be a day: no part of a time, a year or a larger number.
_DAY_WORD = r"(?<![\d:./])(\d{1,2})(?:st|nd|rd|th)?(?![\d:/]|\.\d|[a-z]| ?[ap]\.?m\b)"


def _only(found: Column) -> Column:
    """The one value of an array of equal ones, else null."""
    return F.when(F.size(F.array_distinct(found)) == 1, F.get(found, F.lit(0)))


def _date_of_words(age: Column) -> Column:
    """A month's name, a year and a day in any order, with whatever between them; null if one of these is told in two ways."""
    low = F.lower(age)
    words = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(1))
    month = _only(F.transform(words(_MONTH_WORD), lambda m: F.array_position(F.array(*map(F.lit, _MONTHS)), F.substring(m, 1, 3))))
    day = _only(F.filter(F.transform(words(_DAY_WORD), lambda d: d.cast("int")), lambda d: d.between(1, 31)))
    return F.try_to_date(F.concat(_only(words(_YEAR_WORD)), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")), "yyyy-M-d")


def _date_of_numbers(age: Column) -> Column:
    """Day, month and year, or year, month and day, with dots, slashes or dashes; the month stands first unless it is none."""
    last, first = r"(?<![\d./-])(\d{1,2})[./-](\d{1,2})[./-]((?:19|20)\d{2})(?!\d)", r"(?<![\d./-])((?:19|20)\d{2})[./-](\d{1,2})[./-](\d{1,2})(?!\d)"
    a, b, y = (F.regexp_extract(age, last, k) for k in (1, 2, 3))
    day_first = F.try_to_number(a, F.lit("99")) > 12
    early = F.when(a != "", F.try_to_date(F.when(day_first, F.concat_ws("-", y, b, a)).otherwise(F.concat_ws("-", y, a, b)), "yyyy-M-d"))
    return F.coalesce(early, F.try_to_date(F.concat_ws("-", *[F.regexp_extract(age, first, k) for k in (1, 2, 3)]), "yyyy-M-d"))


def page_date(age: Column) -> Column:
    """The date in free text such as "April 30, 2025"; null without a year from 1900 to 2099 or a date that can be read.

    A date inside prose is found by its shape, or else by its words or numbers in any order.  Relative ages ("3 days ago")
    have no year and give null, and so does a text whose words tell two dates.
    """
    found = F.regexp_extract(age, _DATE_LIKE, 1)
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, r"(?<=\d)(st|nd|rd|th)\b", ""), r"\.", ""), r"^([A-Za-z]+ \d{1,2}) (\d{4})$", "$1, $2")
    clean = F.initcap(F.regexp_replace(clean, r"^(\d{1,2} [A-Za-z]+), (\d{4})$", "$1 $2"))
    reads = [F.try_to_date(clean, f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-M-d", "yyyy/M/d", "M/d/yyyy")]
    by_shape = F.when(found != "", F.coalesce(*reads))
    return F.when(age.rlike(r"\b(19|20)\d{2}\b"), F.coalesce(by_shape, _date_of_numbers(age), _date_of_words(age)))


def safe_url(url: Column) -> Column:
    """https and without an API key."""
    return url.startswith("https://") & ~F.lower(url).contains("api_key")


def decade(d: Column) -> Column:
    return F.concat((F.floor(F.year(d) / 10) * 10).cast("string"), F.lit("s"))


def signed_percent(x: Column) -> Column:
    return F.format_string("%+.2f%%", F.bround(x * 100, 2))


def shown(x: Column, kind: str) -> Column:
    """Display text: pct, ratio or int; n/a for null and NaN."""
    text = {"pct": F.format_string("%.1f%%", F.bround(x * 100, 1)), "ratio": F.format_string("%.2f", F.bround(x, 2)), "int": F.format_string("%d", F.round(x).cast("long"))}[kind]
    return F.when(x.isNull() | F.isnan(x.cast("double")), "n/a").otherwise(text)


def or_none(xs: Column) -> Column:
    return F.when(F.size(F.coalesce(xs, F.array().cast("array<string>"))) > 0, F.array_join(xs, ", ")).otherwise("none")


def trimmed_list(csv: Column) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")
