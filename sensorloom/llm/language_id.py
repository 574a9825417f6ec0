"""Language of a text from n-grams held in a bit-sliced Bloom filter.

A slot of the filter holds one bit for each language, in as many words as they take, so that one look at a few slots and
their common bits give all languages of an n-gram. For each language the n-grams of a text with its
bit are counted; what the filter reports by chance, known from how full each language's bits are, is
taken off; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.chars import BLANK, gram_hashes, plain
from sensorloom.llm.common import map_arrow, text_rows
from sensorloom.sources.scratch import written

#: Lengths of the n-grams. They reach over one blank between words.
GRAMS = (3, 5)
#: Rows of each language that the fit takes, chosen by a hash of the text.
FIT_ROWS = 20_000
#: An n-gram is a language's if it makes up LEAST_RATE of that language's n-grams (which bounds their
#: number) and at least NEAR times the rate of the language in which it is most common.
LEAST_RATE, NEAR = 1e-5, 0.25
WORD = 64
HASHES = 3
#: Characters of a text that are looked up at a time.
CHUNK = 1 << 20

UNDETERMINED = "und"


def padded(text: str) -> np.ndarray:
    """Lower-case words of letters with a blank before and after each, empty without a letter."""
    points, _ = plain(text, digits=False)
    return np.pad(points, 1, constant_values=BLANK) if len(points) else points


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    common: int  # the language of a text in which no known n-gram occurs
    slots: np.ndarray  # one word a slot, or a row of 64-bit words for more than 64 languages
    chance: np.ndarray  # share of unknown n-grams that each language's bits report

    def places(self, grams: np.ndarray, i: int) -> np.ndarray:
        shift = np.uint64(64 - int(len(self.slots)).bit_length() + 1)
        return (grams * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[i]) >> shift).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        out = self.slots[self.places(grams, 0)]
        for i in range(1, HASHES):
            out &= self.slots[self.places(grams, i)]
        return out

    def counts(self, masks: np.ndarray) -> list[int]:
        """For each language, the masks that hold its bit."""
        words = masks.reshape(len(masks), -1)
        return [np.count_nonzero(words[:, i // WORD] & np.array(1 << i % WORD, words.dtype)) for i in range(len(self.languages))]

    def predict(self, text: str) -> tuple[str, float]:
        points = padded(text)
        if not len(points) or not self.languages:
            return UNDETERMINED, 0.0
        hits, total = np.zeros(len(self.languages)), 0
        for n in GRAMS:
            for at in range(0, max(0, len(points) - n + 1), CHUNK):
                masks = self.masks(gram_hashes(points[at : at + CHUNK + n - 1], n))
                total += len(masks)
                if len(self.languages) <= 12:
                    found = np.bincount(masks.astype(np.int64), minlength=1 << len(self.languages))
                    hits += [found[(np.arange(len(found)) >> i) & 1 == 1].sum() for i in range(len(self.languages))]
                else:
                    hits += self.counts(masks)
        if not total:
            return self.languages[self.common], 0.0
        share = np.clip((hits / total - self.chance) / (1 - self.chance), 0, 1)
        best = int(np.argmax(share))
        return (self.languages[best], float(share[best])) if share[best] > 0 else (self.languages[self.common], 0.0)


def _count(languages: dict[str, int]):
    schema = pa.schema([("gram", pa.int64()), ("language", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for language, parts in sorted(held.items()):
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), language, np.int32)), pa.array(n)], schema=schema)

        for batch in batches:
            langs = batch.column(1)
            for i, text in text_rows(batch):
                points = padded(text)
                for n in GRAMS:
                    grams = gram_hashes(points, n)
                    if len(grams):
                        held.setdefault(languages[langs[i].as_py()], []).append(grams)
                        size += len(grams)
                if size > 8_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return run, "gram long, language int, n long"


def fit_languages(train: DataFrame) -> LanguageModel:
    """The model of train (text, lang, and any others). Rows with a null text or lang are left out.

    There may be any number of languages; each takes a bit of a slot. Of each, FIT_ROWS rows or about as
    many are used; a text is in or out by its hash, copies alike. Without rows, the model has no language and each prediction is `und`.
    """
    rows = train.where("text is not null and lang is not null").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = tuple(sorted(sizes))
    common = max(range(len(names)), key=lambda i: (sizes[names[i]], -i), default=0)
    if not names:
        return LanguageModel((), 0, np.zeros(1024, np.uint8), np.zeros(0))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, FIT_ROWS / n))) for k, n in sizes.items()])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30))
    counts = map_arrow(chosen, *_count({k: i for i, k in enumerate(names)})).groupBy("gram").agg(
        *[F.sum(F.when(F.col("language") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(names))]
    )
    counts = written(counts)  # read for the totals and for the masks
    totals = counts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]).first()
    rates = [F.col(f"n{i}") / F.lit(max(1, totals[i] or 0)) for i in range(len(names))]
    most = F.greatest(*rates) if len(rates) > 1 else rates[0]
    bit = [F.when((r >= LEAST_RATE) & (r >= NEAR * most), F.lit(1 << i % WORD if i % WORD < 63 else -(1 << 63))).otherwise(0) for i, r in enumerate(rates)]
    masks = [reduce(Column.bitwiseOR, bit[i : i + WORD]).cast("long").alias(f"mask{i // WORD}") for i in range(0, len(bit), WORD)]
    some = reduce(or_, (F.col(f"mask{w}") != 0 for w in range(len(masks))))
    known = counts.select("gram", *masks).where(some).toPandas()
    size = 1 << max(10, int(8 * len(known)).bit_length())
    kind = next((k for k, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(names) <= b), np.uint64)
    words = np.stack([known[f"mask{w}"].to_numpy().view(np.uint64).astype(kind) for w in range(len(masks))], axis=1)
    model = LanguageModel(names, common, np.zeros((size, len(masks)) if len(masks) > 1 else size, kind), np.zeros(len(names)))
    for i in range(HASHES):
        np.bitwise_or.at(model.slots, model.places(known["gram"].to_numpy().view(np.uint64), i), words if len(masks) > 1 else words[:, 0])
    full = [n / size for n in model.counts(model.slots)]
    return LanguageModel(names, common, model.slots, np.array(full) ** HASHES)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score for each row, from the whole text alone.

    A null text, or one without a letter, gives `und` and 0. A text in which no known n-gram occurs
    gives the language with the most rows and 0. Ties go to the first name. Of columns of these two
    names the old ones are replaced; all others are kept.
    """
    rows = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # slots are bounded by LEAST_RATE
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(text) for _, text in text_rows(batch)]
            names, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, names, scores], names=[*batch.schema.names, "lang_pred", "score"])

    return map_arrow(rows, run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the third of the documents that a fit must not see; false without doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
