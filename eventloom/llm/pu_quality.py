"""Text quality from positives and unlabelled text: the non-negative risk estimator of positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the rest of the corpus is unlabelled, and its labels are not looked
at.  The share of positives in unlabelled text, the class prior, is estimated first: a plain classifier tells positives from
unlabelled rows, and the prior is the least ratio of the unlabelled to the positive share above a score, on rows that it
was not fitted on.  The final classifier then minimises ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the sigmoid
loss; while the second term is negative its gradient is climbed, which keeps the classifier from overfitting the positives.

Features are shares and ratios of characters, words and lines of the whole text, cut into quantile bins; none grows
with the length of the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import freeing, map_texts, ship, stored
from eventloom.llm.sampling import hashed_ids

FOLDS, HELD_FOLD = 3, 1
BINS = 10
#: Words of a block whose distinct words are counted.
BLOCK = 50

#: Classes of Latin-1 characters; whatever lies beyond Latin-1 counts as a letter.
UPPER, LOWER, DIGIT, BLANK, LINE, STOP, SYMBOL, OTHER = range(8)
CLASS = np.full(256, OTHER)
for _b in range(256):
    _c = chr(_b)
    CLASS[_b] = (
        LINE if _c == "\n" else BLANK if _c.isspace() else DIGIT if _c.isdigit() else UPPER if _c.isupper() else LOWER if _c.isalpha()
        else STOP if _c in ".,;:!?'\"()-" else SYMBOL if _c in "#*$%&|<>@^~_=+/\\[]{}`" else OTHER
    )
FEATURES = (
    "upper", "digit", "blank", "line", "stop", "symbol", "other", "exclaim", "bar", "word_length", "long_words", "loud_words", "symbol_words",
    "digit_words", "repeated_next", "block_distinct", "top_word", "line_words", "dup_lines", "sentence_words", "class_changes", "vowels",
)
VOWELS = frozenset(b"aeiouyAEIOUY" + bytes(range(0xC0, 0xC7)) + bytes(range(0xC8, 0xD0)) + bytes(range(0xE0, 0xE7)) + bytes(range(0xE8, 0xF0)))
VOWEL = np.array([b in VOWELS for b in range(256)])
MARKED = re.compile(rb"[#*$%&|<>@^~_=+\\{}\[\]]")
WITH_DIGIT = re.compile(rb"[0-9]")


def features_of(text: str | None) -> list[float]:
    """One number per feature; all are 0 for a text without words."""
    data = text.encode("latin-1", "replace") if text else b""
    # characters beyond Latin-1 arrive as question marks; they are letters of other scripts far more often
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(data, np.uint8)
    counts = np.bincount(codes, minlength=256)
    by_class = np.bincount(CLASS, counts, 8)
    n, k = len(data), len(words)
    letters = max(1.0, by_class[UPPER] + by_class[LOWER])
    lengths = np.fromiter(map(len, words), np.int64, k)
    blocks = [len(set(words[i : i + BLOCK])) / min(BLOCK, k - i) for i in range(0, k, BLOCK) if k - i >= BLOCK or i == 0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen = Counter(lines)
    kinds = CLASS[codes]
    return [
        by_class[UPPER] / letters, by_class[DIGIT] / n, by_class[BLANK] / n, by_class[LINE] / n, by_class[STOP] / n, by_class[SYMBOL] / n, by_class[OTHER] / n,
        counts[33] / n, counts[124] / n, float(np.log1p(lengths).mean()), float((lengths > 20).mean()),
        sum(w.isupper() for w in words) / k, sum(MARKED.search(w) is not None for w in words) / k, sum(WITH_DIGIT.search(w) is not None for w in words) / k,
        sum(map(bytes.__eq__, words[1:], words)) / k, float(np.mean(blocks)), max(max(Counter(words[i : i + BLOCK]).values()) for i in range(0, k, BLOCK)) / BLOCK,
        float(np.log1p(k / len(lines))), 1 - len(seen) / len(lines), float(np.log1p(k / (1 + counts[46] + counts[33] + counts[63]))),
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0, float(counts[VOWEL].sum() / letters),
    ]


@dataclass
class QualityModel:
    """Edges of the bins of every feature, a weight per bin and the intercept; ``prior`` is the estimated class prior."""

    edges: list[np.ndarray]
    weights: np.ndarray
    intercept: float
    prior: float

    def design(self, rows: np.ndarray) -> np.ndarray:
        """Bin numbers as columns of the one-hot design."""
        return np.stack([np.searchsorted(e, rows[:, j], side="right") + j * (BINS + 1) for j, e in enumerate(self.edges)], axis=1)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[self.design(rows)].sum(axis=1) + self.intercept

    def score(self, text: str | None) -> float:
        z = self.margins(np.array([features_of(text)]))[0]
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def edges_of(rows: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Quantiles of each feature as bin edges, with the tails finer than the middle; equal ones are merged by their order."""
    at = np.array([0.01, 0.03, 0.07, 0.15, 0.35, 0.65, 0.85, 0.93, 0.97, 0.99])[:bins]
    return [np.quantile(rows[:, j], at) if len(rows) else np.zeros(bins) for j in range(rows.shape[1])]


def _steps(design_p: np.ndarray, design_u: np.ndarray, size: int, gradient, rounds: int, rate: float, ridge: float) -> tuple[np.ndarray, float]:
    """Adam steps on the weights of the two designs' bins; ``gradient`` gives the slopes of the margins of P and U."""
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        z_p, z_u = w[design_p].sum(axis=1) + w[size], w[design_u].sum(axis=1) + w[size]
        s_p, s_u = gradient(z_p, z_u)
        grad = np.bincount(design_p.ravel(), np.repeat(s_p, design_p.shape[1]), size) + np.bincount(design_u.ravel(), np.repeat(s_u, design_u.shape[1]), size)
        grad = np.append(grad + ridge * w[:size], s_p.sum() + s_u.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def estimate_prior(design_p: np.ndarray, design_u: np.ndarray, size: int, rounds: int = 300) -> float:
    """The share of positives among unlabelled rows.

    A logistic classifier of positives against unlabelled rows is fitted on the even rows.  Of the odd ones, the share of
    unlabelled rows above a score over that of positives is never below the prior but for chance; the least upper bound
    of the ratio over all scores is taken.
    """
    n_p, n_u = len(design_p[::2]), len(design_u[::2])

    def told_apart(z_p, z_u):
        return (_sigmoid(z_p) - 1) / n_p, _sigmoid(z_u) / n_u

    w, b = _steps(design_p[::2], design_u[::2], size, told_apart, rounds, 0.05, 1e-4)
    z_p, z_u = np.sort(w[design_p[1::2]].sum(axis=1) + b), np.sort(w[design_u[1::2]].sum(axis=1) + b)
    if not len(z_p) or not len(z_u):
        return 0.5
    at = np.unique(z_p)
    q_p, q_u = 1 - np.searchsorted(z_p, at) / len(z_p), 1 - np.searchsorted(z_u, at) / len(z_u)
    slack = np.sqrt(np.log(20) / (2 * len(z_p))) + np.sqrt(np.log(20) / (2 * len(z_u)))
    usable = q_p > 0.2  # below, chance decides
    ratio = ((q_u + slack) / q_p)[usable]
    best = np.argmin(ratio)
    return float(np.clip((q_u / q_p)[usable][best], 0.05, 0.98))


def fit_nonnegative(design_p: np.ndarray, design_u: np.ndarray, size: int, prior: float, rounds: int = 800, rate: float = 0.02, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Minimise the non-negative unbiased risk with the sigmoid loss."""
    n_p, n_u = len(design_p), len(design_u)

    def gradient(z_p, z_u):
        s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
        # sigmoid loss of label +1: 1 - s, of label -1: s
        negative = s_u.mean() - prior * s_p.mean()
        slope_p, slope_u = s_p * (1 - s_p) / n_p, s_u * (1 - s_u) / n_u
        if negative < 0:
            return prior * slope_p, -slope_u  # climb the negative part back
        return -2 * prior * slope_p, slope_u

    return _steps(design_p, design_u, size, gradient, rounds, rate, ridge)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, rows: int, doc_id: str, text: str, label: str) -> DataFrame:
    """(positive, x): features of about ``rows`` trusted positives and of about ``rows`` unlabelled documents, all outside the held-out fold."""
    ship(documents.sparkSession)
    key = F.col(f"`{doc_id}`")
    trusted = labels.where(F.col(f"`{label}`").isNotNull() & key.isNotNull() & ~held_out(key)).groupBy(key.alias("__i")).agg(F.min(F.col(f"`{label}`")).alias("__y")).where("__y = 1").select("__i")
    trusted = hashed_ids(trusted, rows).withColumn("__p", F.lit(True))
    ids = hashed_ids(documents.where(key.isNotNull() & ~held_out(key)).select(key.alias("__i")).distinct(), rows).withColumn("__u", F.lit(True))
    # both samples are bounded by ``rows``
    picked = F.broadcast(trusted.join(ids, "__i", "full"))
    joined = documents.select(key.alias("__d"), F.col(f"`{text}`").cast("string").alias("text")).join(picked, F.col("__d") == F.col("__i"))
    one = joined.groupBy("__i").agg(F.min("text").alias("text"), F.first("__p").alias("__p"), F.first("__u").alias("__u"))
    sides = F.array_compact(F.array(F.when(F.col("__p"), True), F.when(F.col("__u"), False)))
    held = one.select("__i", F.col("text"), sides.alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.list_(pa.bool_())), pa.array(made, pa.list_(pa.float64()))], ["id", "sides", "x"])

    made = held.select(F.col("__i").cast("string"), "text", "sides").mapInArrow(freeing(run), "id string, sides array<boolean>, x array<double>")
    return made.select("id", F.explode("sides").alias("positive"), "x")


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = 20_000,
    prior: float | None = None,
) -> QualityModel:
    """The classifier from about ``fit_rows`` trusted positives and as many unlabelled rows (documented bound).

    Rows of the held-out fold are never used, labels other than 1 only to tell that a row is no trusted positive.
    Without positives or unlabelled rows every text gets the score 0.5.
    """
    got = stored(training_rows(documents, labels, fit_rows, doc_id, text, label), "quality-rows").orderBy(F.md5("id"), "positive").collect()
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    positive = np.array([r.positive for r in got], bool)
    size = len(FEATURES) * (BINS + 1)
    model = QualityModel(edges_of(x[~positive]), np.zeros(size), 0.0, 0.5)
    if not positive.any() or positive.all():
        return model
    p, u = model.design(x[positive]), model.design(x[~positive])
    model.prior = estimate_prior(p, u, size) if prior is None else prior
    model.weights, model.intercept = fit_nonnegative(p, u, size, model.prior)
    return model


def score_documents(documents: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every whole text.

    Null and empty texts are scored by features of 0; a null id is in no fold.  Rows are scored alone: repeated rows
    repeat, an empty table gives no rows, other columns are not read.
    """

    def start():
        return lambda value: (model.score(value),)

    scored = map_texts(documents, [doc_id], text, "score double", start)
    return scored.select(doc_id, held_out(F.col(f"`{doc_id}`")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
