"""Scalar functions over text columns: money, durations, numbers, dates, identifiers. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose matches are part of the results.
MONEY = (
    r"(?i)(?:USD|GBP|EUR|INR|£|\$|€|₹)\s*[\d,]+(?:\.\d{1,2})?(?:\s*(?:million|m|k|thousand|lakh|lakhs|crore|crores))?"
    r"|[\d,]+(?:\.\d{1,2})?\s*(?:USD|GBP|EUR|INR|dollars?|pounds?|euros?|rupees?)(?:\s*(?:million|m|k|thousand|lakh|lakhs|crore|crores))?"
)
DURATION = r"(?i)\b(?:\w+\s+)?\(?(\d+)\)?\s*(?:calendar\s+)?(?:business\s+)?(?:days?|weeks?|months?|years?)\b"
PAYMENT_TERMS = r"(?i)\b(?:net\s+\d+(?:\s+days?)?|due\s+on\s+receipt|payable\s+(?:within|in)\s+\d+\s+days?)\b"
DATE = (
    r"(?i)\b(?:(?=[ADFJMNOS])(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}"
    r"|(?=\d)(?:\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b|\d{4}[\/\-]\d{1,2}[\/\-]\d{1,2}\b))"
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """Without blanks, tabs and line ends at both ends."""
    return F.trim(text, F.lit(" \t\n\r\f\x0b"))


def first(text: Column, pattern: str) -> Column:
    """First match, trimmed; null if there is none."""
    return F.trim(F.regexp_substr(text, F.lit(pattern)))


def parse_days(text: Column) -> Column:
    """Days of a number directly followed by day, week (7), month (30) or year (365); null if there is none."""
    low = F.lower(text)
    n = F.regexp_extract(low, r"(\d+)\s*(day|week|month|year)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"(\d+)\s*(day|week|month|year)", 2)
    return n * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365)


def parse_number(text: Column, cheap: bool = False) -> Column:
    """A number with its scale word or suffix; the sign is not read; null if the digits aren't a number. cheap: the text is at hand."""

    def scale(low):
        return (
            F.when(low.contains("billion") | low.endswith("b"), 1e9)
            .when(low.contains("million") | low.endswith("m"), 1e6)
            .when(low.contains("thousand") | low.endswith("k"), 1e3)
            .otherwise(1.0)
        )

    # The text may be a match of a pattern: it is made once, however often it is looked at. Only other signs can be a scale.
    number = lambda t: plain_number(t) * F.when(t.rlike(r"[^\d.,\s$-]"), let(F.lower(F.trim(t)), scale)).otherwise(1.0)
    return number(text) if cheap else let(text, number)


def plain_number(text: Column) -> Column:
    """The number of a text's digits and dots, for texts without a scale."""
    return F.regexp_replace(text, r"[^\d.]+", "").try_cast("double")


def _first_date(text: Column, formats: dict[str, str]) -> Column:
    """formats: each with a shape that whatever it reads has, as a format that fails costs an exception of the JVM."""
    return F.coalesce(*(F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(f)))) for f, shape in formats.items()))


#: Formats of dates and the shapes of what they can read. A year may have a sign.
LOOSE_FORMATS = {
    "MMMM d, yyyy": r"^\pL+ [^, ]+, ", "MMMM d yyyy": r"^\pL+ [^, ]+ ", "d MMMM yyyy": r"^\S+ \pL+ ", "d MMMM, yyyy": r"^\S+ \pL+, ", "d/M/yyyy": r"^[^/]+/[^/]+/[^/]+$", "M/d/yyyy": r"^[^/]+/[^/]+/[^/]+$",
    "yyyy-M-d": r"^[+-]?\d{4,}-", "d-M-yyyy": r"^\d+-\d+-[+-]?\d{4,}$", "M-d-yyyy": r"^\d+-\d+-[+-]?\d{4,}$", "d.M.yyyy": r"\..*\.",
}
STRICT_FORMATS = {
    "d-MMM-yyyy": r"^\d+-[A-Za-z]{3,4}-", "yyyy-M-d": r"^\d{4,}-", "d-M-yyyy": r"^\d+-\d+-+\d{4,}$", "d-MMMM-yyyy": r"^\d+-[A-Za-z]+-", "MMMM-d--yyyy": r"^[A-Za-z]+-.*--",
}


def parse_date_loose(text: Column) -> Column:
    """Dates of anomaly rules, by the first format that fits: month names with or without a comma, the day before the month where
    both fit. Whole text only; null if none fits."""
    return _first_date(F.rtrim(strip(text), F.lit(".,;")), LOOSE_FORMATS)


def parse_date_strict(text: Column) -> Column:
    """Dates of cross-document rules: whatever is no letter or digit is a dash, dashes at the ends go; never the month first."""
    dashed = F.trim(F.regexp_replace(text, r"[^A-Za-z0-9]", "-"), F.lit("-"))
    return _first_date(dashed, STRICT_FORMATS)


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def clean_ocr(text: Column) -> Column:
    """Joins hyphenated words, mends l read as | or brackets within words, expands ligatures, drops spaces before punctuation."""
    t = F.regexp_replace(text, r"([A-Za-z])-\s+([a-z])", "$1$2")
    t = F.regexp_replace(t, r"(?<=[A-Za-z])[|\[\]](?=[A-Za-z])", "l")
    # Ligatures.
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"\s+([.,;:?!])", "$1")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def clean_markdown(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?m)^#+\s*", "")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(t, r"[*_`]", ""))
