"""Quality of texts from overlapping heuristic labellers and a hashed linear scorer.

Each labeller votes good, bad or not at all. Spark counts how often each pattern of votes occurs in all
texts; expectation-maximisation over the patterns estimates what each labeller votes on good and bad
texts, and with that the probability that a text of each pattern is good. These probabilities are the
labels on which a linear scorer of hashed features is trained, which judges texts by their make-up alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm.common import map_arrow, text_rows
from sensorloom.llm.wordhash import word_hashes

#: Texts that the scorer is trained on, chosen by a hash of the text; the labellers are judged on all.
FIT_ROWS = 20_000
#: Hashed features of the scorer.
FEATURES = 1 << 13
ROUNDS, STEPS, RATE, DECAY = 60, 300, 2.0, 1e-4

# Frequent function words of the languages at hand.
FUNCTION_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les par pas pour que qui sur un une "
    "als auf das dem den der die ein eine im ist mit nicht sich und von zu "
    "como con del el es los para por se su y"
).split()
LABELLERS = ("symbols", "capitals", "repeated_lines", "distinct_words", "bare_marks", "function_words", "exclamations", "digits", "length")
GOOD, BAD, NONE = 2, 1, 0

_CLASS = np.full(256, 1, np.uint8)  # 1: letters
_CLASS[:128] = [2 if chr(i).isupper() else 3 if chr(i).isdigit() else 1 if chr(i).islower() else 4 for i in range(128)]
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\"]] = True
_FUNCTION = np.unique([word_hashes(w)[0] for w in dict.fromkeys(FUNCTION_WORDS)])
#: Classes for the scorer: letters, capitals, digits, white space, and each ASCII mark on its own.
_KIND = _CLASS.astype(np.int64)
_KIND[_CLASS == 4] = np.flatnonzero(_CLASS == 4) + 8


def _vote(good: bool, bad: bool) -> int:
    return GOOD if good else BAD if bad else NONE


def votes_of(text: str, data: np.ndarray, words: np.ndarray) -> list[int]:
    """The vote of each labeller, in the order of LABELLERS."""
    n = max(1, len(data))
    kinds = np.bincount(_CLASS[data], minlength=5)
    letters, n_words = max(1, kinds[1] + kinds[2]), len(words)
    symbols = np.count_nonzero(_SYMBOL[data]) / n
    capitals = kinds[2] / letters
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    distinct = len(np.unique(words)) / max(1, n_words)
    blank = _CLASS[data] == 0
    mark = _CLASS[data] == 4
    lone = np.count_nonzero(mark & np.r_[True, blank[:-1]] & np.r_[blank[1:], True]) if len(data) else 0
    bare = lone / max(1, n_words)
    function = np.isin(words, _FUNCTION).sum() / max(1, n_words)
    loud = np.count_nonzero(data == ord("!")) / max(1, n_words)
    digits = kinds[3] / n
    return [
        _vote(symbols < 0.002, symbols > 0.02),
        _vote(0.002 < capitals < 0.1, capitals > 0.3),
        _vote(len(lines) > 3 and repeated == 0, len(lines) > 1 and repeated > 0.3),
        _vote(n_words >= 20 and distinct > 0.5, n_words >= 20 and distinct < 0.3),
        _vote(n_words >= 20 and bare == 0, bare > 0.05),
        _vote(n_words >= 20 and function > 0.08, n_words >= 20 and function < 0.04),
        _vote(False, loud > 0.1),
        _vote(False, digits > 0.05),
        _vote(n_words >= 30, False),
    ]


def features_of(text: str, data: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the hashed features: runs of three character classes, and how much repeats."""
    kind = _KIND[data]
    runs = kind[np.r_[True, kind[1:] != kind[:-1]]] if len(kind) else kind
    grams = (runs[:-2] * 160 + runs[1:-1]) * 160 + runs[2:] if len(runs) > 2 else np.empty(0, np.int64)
    place = ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)).astype(np.int64)
    counts = np.bincount(place, minlength=FEATURES // 2) / max(1, len(grams))
    lines = text.split("\n")
    shares = [len(set(lines)) / len(lines), len(np.unique(words)) / max(1, len(words)), np.isin(words, _FUNCTION).sum() / max(1, len(words))]
    more = [FEATURES // 2 + 64 * i + min(20, int(20 * s)) for i, s in enumerate(shares)]
    more.append(FEATURES // 2 + 192 + min(20, int(2 * np.log2(len(words) + 1))))
    at = np.flatnonzero(counts)
    return np.append(at, more).astype(np.int32), np.append(np.sqrt(counts[at]), np.full(4, 0.5)).astype(np.float32)


def _code(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = code * 3 + v
    return code


def _parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), word_hashes(text)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_code(votes_of(text, *_parts(text))) for _, text in text_rows(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64())], names=["pattern"])


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pattern", pa.int64()), ("places", pa.binary()), ("amounts", pa.binary())])
    for batch in batches:
        out = [[], [], []]
        for _, text in text_rows(batch):
            parts = _parts(text)
            places, amounts = features_of(text, *parts)
            for column, v in zip(out, (_code(votes_of(text, *parts)), places.tobytes(), amounts.tobytes()), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def label_patterns(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each pattern, and (class, labeller, vote) probabilities, by expectation-maximisation.

    It begins with the share of good among a pattern's votes, which settles which class is which.
    """
    n = len(LABELLERS)
    votes = (patterns[:, None] // 3 ** np.arange(n - 1, -1, -1)) % 3
    onehot = (votes[:, :, None] == np.arange(3)).astype(float)
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    p = (good + 0.5) / (good + bad + 1)
    table = np.zeros((2, n, 3))
    onehot[:, :, NONE] = 0  # no vote says nothing: what counts is how often a vote that is cast is right
    for _ in range(ROUNDS):
        weight = np.stack([(1 - p) * counts, p * counts])
        table = np.einsum("cp,pnv->cnv", weight, onehot) + 0.5
        table /= table.sum(2, keepdims=True)
        share = (weight.sum(1) + 1) / (weight.sum() + 2)
        log = np.log(share)[:, None] + np.einsum("pnv,cnv->cp", onehot, np.log(table))
        p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return p, table


class QualityModel:
    """Pattern probabilities (at most 3 ** labellers) and the scorer's weights."""

    def __init__(self, known: dict[int, float], weights: np.ndarray, bias: float, labellers: np.ndarray) -> None:
        self.known, self.weights, self.bias, self.labellers = known, weights, bias, labellers

    def judge(self, text: str) -> tuple[float, float]:
        """Probability of good by the labellers, and by the scorer."""
        parts = _parts(text)
        places, amounts = features_of(text, *parts)
        z = float(self.weights[places] @ amounts) + self.bias
        return self.known.get(_code(votes_of(text, *parts)), 0.5), float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def train_scorer(places: list[np.ndarray], amounts: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression on soft labels, by gradient steps with momentum."""
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    place, amount = np.concatenate(places), np.concatenate(amounts).astype(float)
    w, b = np.zeros(FEATURES), 0.0
    speed, speed_b = np.zeros(FEATURES), 0.0
    # Both classes weigh the same, however rare one is.
    weight = target / max(target.sum(), 1e-9) / 2 + (1 - target) / max((1 - target).sum(), 1e-9) / 2
    for _ in range(STEPS):
        z = np.bincount(row, w[place] * amount, len(target)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target)
        speed = 0.9 * speed - RATE * (np.bincount(place, error[row] * amount, FEATURES) + DECAY * w)
        speed_b = 0.9 * speed_b - RATE * error.sum()
        w, b = w + speed, b + speed_b
    return w, b


def fit_quality(docs: DataFrame) -> QualityModel:
    """The model of docs (text, and any others); null texts are left out.

    Votes are counted over all texts; the scorer is trained on FIT_ROWS different texts at most or about as
    many, chosen by a hash. Without texts, all probabilities are one half.
    """
    texts = docs.where("text is not null").select(F.lit(0).alias("at"), "text")
    counted = map_arrow(texts, _patterns, "pattern long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").toPandas()
    if counted.empty:
        return QualityModel({}, np.zeros(FEATURES), 0.0, np.zeros((2, len(LABELLERS), 3)))
    patterns, n = counted["pattern"].to_numpy(), counted["n"].to_numpy()
    p, table = label_patterns(patterns, n)
    known = dict(zip(patterns.tolist(), p.tolist(), strict=True))
    share = min(1.0, FIT_ROWS / n.sum())
    chosen = texts.where(F.pmod(F.xxhash64("text", F.lit("fit")), F.lit(1 << 30)) < share * (1 << 30))
    chosen = chosen.dropDuplicates(["text"])  # a text of which there are many copies counts once
    sample = map_arrow(chosen, _training, "pattern long, places binary, amounts binary").toPandas()
    if sample.empty:
        return QualityModel(known, np.zeros(FEATURES), 0.0, table)
    places = [np.frombuffer(x, np.int32) for x in sample["places"]]
    amounts = [np.frombuffer(x, np.float32) for x in sample["amounts"]]
    weights, bias = train_scorer(places, amounts, sample["pattern"].map(known).to_numpy())
    return QualityModel(known, weights, bias, table)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with weak_label and quality (0 to 1) for each row, from the whole text.

    A null text counts as empty. Old columns of these names are replaced, all others kept. An empty
    table gives an empty result.
    """
    rows = docs.drop("weak_label", "quality")
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("weak_label", T.DoubleType()), T.StructField("quality", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.judge(text) for _, text in text_rows(batch)]
            new = [pa.array([x[i] for x in found], pa.float64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "weak_label", "quality"])

    return map_arrow(rows, run, schema)
