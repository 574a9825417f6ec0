"""Casts that turn what they cannot read into NULL, never into an error.

Each uses its input as few times as it can: the optimizer copies an input into every place that
uses it when it moves a filter below a projection, and copies of copies grow fast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.config import CSV_NULL_MARKERS, SENTINELS

# Dates with slashes or dots, and dates that start with the day or the month. Years of two digits
# are those from 1969 on, as pandas and POSIX read them.
_YEAR_FIRST = (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3")
_MONTH = r"(0?[1-9]|1[0-2])"
# Years of two digits get their century first, so that one pattern reads all years of an order.
_SHORT_YEARS = [(r"^(\d{1,2}[-/.]\d{1,2}[-/.])(69|[7-9]\d)(?!\d)", "$119$2"), (r"^(\d{1,2}[-/.]\d{1,2}[-/.])([0-5]\d|6[0-8])(?!\d)", "$120$2")]
_DAY_FIRST = (rf"^(\d{{1,2}})[-/.]{_MONTH}[-/.](\d{{4}})", "$3-$2-$1")
_MONTH_FIRST = (rf"^{_MONTH}[-/.](\d{{1,2}})[-/.](\d{{4}})", "$3-$1-$2")

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH_NUMBERS = "".join(f"{name}{i:02d}" for i, name in enumerate(MONTHS, 1))
_MONTH_NAME = rf"(?i)(?<![a-z])({'|'.join(MONTHS)})[a-z]*\.?"
_WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.]?\s+"
# Whether a text may name a month. Its name is written M and its number before the patterns of _named apply.
_NAMES_MONTH = rf"(?i)(?<![a-z])(?:{'|'.join(MONTHS)})|M\d\d"


def _named(day_first: bool) -> list[tuple[str, str]]:
    """Dates with a month M and its number, turned into numbers in the order that is tried first."""
    day_month = (r"^(\d{1,2})(?:st|nd|rd|th)?[-/. ]*M(\d\d)[-/., ]*(?=\d)", "$1-$2-" if day_first else "$2-$1-")
    month_day = (r"^M(\d\d)[-/. ]*(\d{1,2})(?:st|nd|rd|th)?[-/., ]+(?=\d)", "$2-$1-" if day_first else "$1-$2-")
    return [day_month, month_day, (r"^(\d{4})[-/. ]*M(\d\d)[-/. ]*(\d{1,2})", "$1-$2-$3")]


_CLOCK = r"(:\d{2})?(:\d{2})?(\.\d+)?\s*"
# An hour of two halves: the hour, its minutes, seconds and fraction, the half.
_HALF_DAY = rf"(?i)[,T ]\s*(12|0?(?:1[01]|[1-9])){_CLOCK}([ap])\.?m\.?$"
_OFFSET = r"(\d:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$"

# Which of two numbers can only be the day, for the vote of a column.
DAY_ONLY = r"^(1[3-9]|2\d|3[01])[-/.](0?[1-9]|1[0-2])[-/.]\d"
MONTH_ONLY = r"^(0?[1-9]|1[0-2])[-/.](1[3-9]|2\d|3[01])[-/.]\d"


def null_markers(c: Column) -> Column:
    """Cells a CSV reader takes as missing, compared before trimming."""
    return F.when(~c.isin(*CSV_NULL_MARKERS, *SENTINELS), c)


def clean_text(c: Column) -> Column:
    """Trim; sentinel words and blanks become NULL."""
    # btrim with an explicit set also strips tabs and line ends, as a text trim should.
    trimmed = F.btrim(c, F.lit(" \t\r\n\f"))
    return F.when(~trimmed.isin(*SENTINELS, ""), trimmed)


def to_number(c: Column) -> Column:
    """Double, or NULL when the text is no number; NaN counts as missing."""
    # Java reads a trailing d or f as a type suffix ("1.5d"), which is no number here.
    suffixed = F.substring(c, -1, 1).isin("d", "D", "f", "F") & ~c.ilike("%inf")
    return nan_to_null(F.when(~suffixed, c).try_cast("double"))


# A plain decimal, and one in its shortest spelling.
_PLAIN = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
_SHORTEST = r"^(?:0|-?(?:[1-9]\d*|(?:0|[1-9]\d*)\.\d*[1-9]))$"


def _by_value(c: Column) -> Column:
    """The spelling of a number that is no plain decimal."""
    value = to_number(c)
    whole = F.when((F.abs(value) < 1e15) & (value == F.floor(value)), value.cast("decimal(20, 0)").cast("string"))
    return F.coalesce(whole, value.cast("string"))


def canonical_number(c: Column) -> Column:
    """One spelling for each number: 1, 1.0, +1.00 and 01 are 1. NULL if the text is no number.

    Plain decimals keep all their digits, however many; only those with an exponent pass through a double.
    """
    plain = F.regexp_replace(c, r"^\+", "")
    for pattern, text in (
        (r"^(-?)0+(?=\d)", "$1"),
        (r"^(-?)\.", "$10."),  # there is no tenth group, so this is the first and a zero
        (r"(\.\d*?)0+$", "$1"),
        (r"\.$", ""),
        (r"^-0$", "0"),
    ):
        plain = F.regexp_replace(plain, pattern, text)
    return F.when(c.rlike(_SHORTEST), c).when(c.rlike(_PLAIN), plain).otherwise(_by_value(c))


def other_spelling(c: Column) -> Column:
    """Whether a number is written in another way than its canonical one; NULL or false if the text is no number."""
    return F.when(c.rlike(_SHORTEST), False).when(c.rlike(_PLAIN), True).otherwise(_by_value(c) != c)


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def _with_numbers(c: Column, day_first: bool) -> Column:
    """Month names as numbers and hours of two halves as hours of the day; the weekday goes.

    One pass each: the number written is that of the first name, or of the only hour, in the text. A
    text that names two months is no date either way.
    """
    name = F.lower(F.regexp_extract(c, _MONTH_NAME, 1))
    month = F.concat(F.lit("M"), F.substr(F.lit(_MONTH_NUMBERS), F.position(name, F.lit(_MONTH_NUMBERS)) + 3, F.lit(2)))
    hour = F.regexp_extract(c, _HALF_DAY, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(c, _HALF_DAY, 5)) == "p", 12).otherwise(0)
    clock = F.concat(F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit("$2$3$4"))
    halved = F.coalesce(F.when(c.rlike(r"(?i)m\.?$"), clock), F.lit(""))
    rest = F.regexp_replace(c, _WEEKDAY, "")
    named = F.regexp_replace(rest, F.lit(_MONTH_NAME), month)
    for pattern, text in _named(day_first):
        named = F.regexp_replace(named, pattern, text)
    read = F.when(c.rlike(_NAMES_MONTH), named).otherwise(rest)
    return F.regexp_replace(F.regexp_replace(read, F.lit(_HALF_DAY), halved), r" (\d{2})$", " $1:00")


def to_moment(c: Column, day_first: bool = True) -> Column:
    """Timestamp without zone from text: ISO, numbers with the day or the month first, month names.

    Where two numbers could both be the month, day_first decides; a number above 12 is the day.
    Years may have two digits, hours AM or PM. An offset is dropped: the clock time stays as written.
    """
    # ISO dates need no other pattern. Letters are those of names and halves, not T and Z alone.
    iso = c.rlike(r"(?s)^\d{4}-\d(?!.*[A-Za-z]{2})")
    read = F.when(c.rlike("[A-Za-z]{2}"), _with_numbers(c, day_first)).otherwise(c)
    orders = (_DAY_FIRST, _MONTH_FIRST) if day_first else (_MONTH_FIRST, _DAY_FIRST)
    for pattern, text in (_YEAR_FIRST, *_SHORT_YEARS, *orders):
        read = F.regexp_replace(read, pattern, text)
    return F.regexp_replace(F.when(iso, c).otherwise(read), _OFFSET, "$1").try_cast("timestamp_ntz")


def to_day(c: Column) -> Column:
    """Calendar day of a text timestamp."""
    return to_moment(F.btrim(c), day_first=False).cast("date")
