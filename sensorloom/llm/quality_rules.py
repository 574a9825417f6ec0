"""Quality rules: a table of thresholds compiled into one projection over counts of each text.

Words are the runs between ASCII white space, lines the parts between line feeds; a line counts if it
holds a word. All counts and the verdict are Spark expressions over the row's own text: nothing is
shuffled and no user function runs, so a hot source or a group of copies is no special case.

A null text counts as an empty one: it has no words and fails. Every rule compares whole numbers
(1000 * part with limit * whole), so that the verdict does not depend on rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words below which a text fails, and the share of repeated words (per thousand) above which it does.
LEAST_WORDS, MOST_REPEATED = 50, 500

WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages at hand.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "als auf das dem den der die ein eine im ist mit nicht sich und von zu "
    "como con del el es los para por se su y"
).split()

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
    "n_letter_words",
    "n_lines",
    "n_bullet_lines",
    "n_ellipsis_lines",
)


@dataclass(frozen=True)
class Rule:
    """Fails a text if part / whole is below least or above most, both in thousandths.

    Without a whole, part itself is compared with the limits.
    """

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None

    def failed(self) -> Column:
        part, whole = F.col(self.part), F.lit(1)
        if self.whole is not None:
            part, whole = part * 1000, F.col(self.whole)
        bad = F.lit(False)
        if self.least is not None:
            bad = bad | (part < whole * self.least)
        if self.most is not None:
            bad = bad | (part > whole * self.most)
        return bad


#: The rules that the base verdict consists of.
BASE = (
    Rule("words", "n_words", least=LEAST_WORDS),
    Rule("repeated_words", "n_repeat_words", "n_words", most=MOST_REPEATED),
)
#: The rules for the rest.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 15_000),
    Rule("symbols", "n_symbols", "n_words", most=100),
    Rule("stop_words", "n_stop_words", "n_words", least=20),
    Rule("letters", "n_letter_words", "n_words", least=800),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=300),
)


def _windows(words: Column, make: Callable[..., Column]) -> Column:
    """make(...) of the three words at each place at which a window of three begins, with the place."""
    rows = F.transform(
        words,
        lambda w, i: F.struct(make(w, F.get(words, i + 1), F.get(words, i + 2)).alias("key"), i.alias("at")),
    )
    return F.slice(rows, 1, F.greatest(F.size(words) - 2, F.lit(0)))


def _shared(rows: Column) -> Column:
    """The rows of a sorted array that have their key in common with the row before or after."""
    return F.filter(
        rows,
        lambda r, i: F.coalesce(
            (r["key"] == F.get(rows, i - 1)["key"]) | (r["key"] == F.get(rows, i + 1)["key"]),
            r["key"] == F.get(rows, i - 1)["key"],
            r["key"] == F.get(rows, i + 1)["key"],
            F.lit(False),
        ),
    )


def _count(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test)).cast("long")


def count_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df with the columns COUNTS; columns of df with these names are replaced.

    n_repeat_words counts the words that lie in a window of three words which occurs twice or more in
    the text: windows that share a hash with another are sorted again as texts, and those equal to a
    neighbour cover the words. A hash alone decides nothing.
    """
    whole, words, lines = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col("_qr_words"), F.col("_qr_lines")
    near, exact, at = F.col("_qr_near"), F.col("_qr_exact"), F.col("_qr_at")
    own = df.columns
    df = df.withColumn("_qr_text", whole)
    df = df.withColumns(
        {
            "_qr_words": F.regexp_extract_all("_qr_text", F.lit(WORD + "+"), F.lit(0)),
            "_qr_lines": F.filter(F.split("_qr_text", "\n", -1), lambda line: line.rlike(WORD)),
            "n_symbols": F.length(F.regexp_replace("_qr_text", f"[^{SYMBOLS}]+", "")).cast("long"),
        }
    )
    df = df.withColumn("_qr_near", F.sort_array(_windows(words, F.xxhash64)))
    df = df.withColumn("_qr_near", F.transform(_shared(near), lambda r: r["at"]))
    df = df.withColumn(
        "_qr_exact",
        F.sort_array(
            F.transform(
                near,
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("key"), i.alias("at")
                ),
            )
        ),
    )
    df = df.withColumn("_qr_at", F.sort_array(F.transform(_shared(exact), lambda r: r["at"])))
    stop = [w for w in dict.fromkeys(STOP_WORDS)]
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.concat_ws("", words)).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            # Each window covers three words, less those that the next one covers too.
            "n_repeat_words": F.aggregate(
                F.transform(at, lambda a, i: F.least(F.coalesce(F.get(at, i + 1) - a, F.lit(3)), F.lit(3))),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
            "n_stop_words": _count(words, lambda w: F.lower(w).isin(stop)),
            "n_letter_words": _count(words, lambda w: w.rlike("\\p{L}")),
            "n_lines": F.size(lines).cast("long"),
            "n_bullet_lines": _count(lines, lambda line: line.rlike("^[\\x20\\x09]*[-*•‣]")),
            "n_ellipsis_lines": _count(lines, lambda line: line.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$")),
        }
    )
    return df.select(*[F.col(f"`{c}`") for c in own if c not in COUNTS], *COUNTS)


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with COUNTS, base_failed, failed_rules (names, base rules first) and kept.

    kept is true if no rule fails. Columns of df with these names are replaced.
    """
    df = count_texts(df, text)
    own = [c for c in df.columns if c not in ("base_failed", "failed_rules", "kept")]

    def failed(table: tuple[Rule, ...]) -> Column:
        return F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in table]))

    base = reduce(or_, (r.failed() for r in BASE))
    every = reduce(or_, (r.failed() for r in rules), base)
    return df.select(*[F.col(f"`{c}`") for c in own], base.alias("base_failed"), failed(BASE + rules).alias("failed_rules"), (~every).alias("kept"))
