"""Toxicity by weak supervision: voters, a generative model of their accuracies and correlations, a linear classifier.

Voters are lexicon words, word beginnings found in labelled training rows, disguised spellings and patterns of style; each says toxic,
clean or nothing.  A two-class model fitted by expectation maximisation estimates how often each voter speaks in either class,
given what the voter says that it follows most closely: dependencies form a forest of pairwise factors, chosen by the
correlations within the classes.  Its posteriors, not the labels, train a logistic classifier on words and word beginnings,
which scores every text.  Votes and features are shares of the text's words, so that no score grows with length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import freeing, map_texts, ship, stored
from eventloom.llm.sampling import hashed_ids

#: Common insults, in the languages of the corpus.
LEXICON = {
    "en": ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "dumb", "jerk", "bastard", "bitch", "asshole", "hate", "kill"),
    "de": ("idiotin", "dumm", "dummkopf", "abschaum", "arschloch", "trottel", "schwein", "widerlich", "versager", "hure"),
    "fr": ("imbecile", "imbécile", "connard", "salope", "ordure", "crétin", "abruti", "dégueulasse", "pute", "raté"),
    "es": ("idiota", "imbécil", "estúpido", "basura", "cabrón", "gilipollas", "mierda", "escoria", "puta", "asqueroso"),
}
WORD = re.compile(r"[^\W\d_]+")
CENSORED = re.compile(r"(?<!\w)[A-Za-z][*#@$%]{2,}[A-Za-z](?!\w)")
INSULT_FORM = re.compile(r"\b(?:you|du|tu|eres)\b[^.!?\n]{0,20}\b(?:are|bist|es|eres)\b", re.I)
BEGINNINGS = (4, 5, 6, 7, 8)
#: A gram counts in full once it stands once in so many words, and less the rarer it is.
SPAN = 130
#: A voter speaks if what it looks for stands once in so many words, or in a shorter text; one that looks for a single mark, once in more.
VOTE_SPAN = 200
MARK_SPAN = 1000
#: Digits and signs that stand for letters.
DISGUISE = str.maketrans("013457@$", "oieastas")
DISGUISED = re.compile(r"(?<![\w@$])(?=[\w@$]*[^\W\d_])(?=[\w@$]*[\d@$])[\w@$]{3,20}")
#: Least correlation within the classes of voters that a factor joins.
TIED = 0.15
ABSTAIN, TOXIC, CLEAN = 0, 1, 2


def words_in(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(words: Iterable[str]) -> set[str]:
    """Whole words and, marked by a star, their beginnings."""
    return set(gram_numbers(words))


def gram_numbers(words: Iterable[str]) -> Counter[str]:
    """How often each gram stands among the words."""
    out: Counter[str] = Counter()
    for w, n in Counter(words).items():
        if len(w) > 2:
            out[w] += n
            for k in BEGINNINGS:
                if len(w) > k:
                    out[w[:k] + "*"] += n
    return out


def share(count: int, words: int, span: int = SPAN) -> float:
    """1 for a gram that stands once in ``span`` words or in a shorter text, less for a rarer one."""
    return min(1.0, count * span / max(words, span))


@dataclass(frozen=True)
class Voters:
    """``marks``: grams that vote toxic, one voter each; further voters look at style and at the lexicon as a whole."""

    marks: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.marks, *[f"lexicon_{k}" for k in LEXICON], "disguised", "several", "shouting", "censored", "address", "nothing_found")

    def vote(self, text: str | None) -> list[int]:
        words = words_in(text)
        grams = gram_numbers(words)

        def speaks(count: int, span: int = VOTE_SPAN) -> int:
            return TOXIC if count and count * span >= max(len(words), span) else ABSTAIN

        out = [speaks(grams.get(m, 0), MARK_SPAN) for m in self.marks]
        kinds = [w for ws in LEXICON.values() for w in ws if w in grams]
        out += [speaks(sum(grams.get(w, 0) for w in ws)) for ws in LEXICON.values()]
        plain = [m[0].translate(DISGUISE).lower() for m in DISGUISED.finditer(text or "")]
        out.append(speaks(sum(w in ws for w in plain for ws in LEXICON.values())))
        found = any(out)
        different = len({m[:4] for m in [*kinds, *[m for m in self.marks if m in grams]]})
        out.append(speaks(different) if different > 1 else ABSTAIN)
        letters = [c for c in text or "" if c.isalpha()] if text and "!" in text else []
        loud = len(letters) > 40 and sum(c.isupper() for c in letters) > 0.5 * len(letters)
        out += [TOXIC if loud else ABSTAIN, speaks(len(CENSORED.findall(text or "")))]
        out += [TOXIC if found and INSULT_FORM.search(text or "") else ABSTAIN, ABSTAIN if found else CLEAN]
        return out


@dataclass
class LabelModel:
    """Class prior, vote probabilities, the factors that tie voters, and what is a voter's own beyond the one it follows.

    ``tables[j, y, v]`` are a voter's votes in either class; ``parent[j]`` is the voter that it follows (-1 for none) and
    ``tied[j, y, u, v]`` its votes given that one's vote ``u``.
    """

    prior: float = 0.1
    tables: np.ndarray = field(default_factory=lambda: np.empty((0, 2, 3)))
    correlations: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    parent: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    tied: np.ndarray = field(default_factory=lambda: np.empty((0, 2, 3, 3)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for rows of votes."""
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            p = self.parent[j] if len(self.parent) else -1
            if p < 0:
                odds += np.log(self.tables[j, 1] / self.tables[j, 0])[votes[:, j]]
            else:
                odds += np.log(self.tied[j, 1] / self.tied[j, 0])[votes[:, p], votes[:, j]]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """For each voter, how often it is right when it speaks."""
        p = np.array([1 - self.prior, self.prior])
        right = self.tables[:, 1, TOXIC] * p[1] + self.tables[:, 0, CLEAN] * p[0]
        return right / np.maximum((self.tables[:, :, 1:] * p[:, None]).sum(axis=(1, 2)), 1e-12)


def dependencies(correlations: np.ndarray, least: float = TIED) -> np.ndarray:
    """The voter that each one follows: a maximum spanning forest over the correlations of ``least`` or more, rooted at its first voters."""
    k = len(correlations)
    parent, inside = np.full(k, -1), np.zeros(k, bool)
    for root in range(k):
        if inside[root]:
            continue
        inside[root] = True
        tree = [root]
        while True:
            reach = np.where(inside[None, :], -1.0, correlations[tree])
            if not reach.size or reach.max() < least:
                break
            a, b = np.unravel_index(reach.argmax(), reach.shape)
            parent[b], inside[b] = tree[a], True
            tree.append(int(b))
    return parent


def fit_label_model(votes: np.ndarray, rounds: int = 40, smooth: float = 0.5) -> LabelModel:
    """Expectation maximisation from the voters' majority; the correlations within the classes choose the factors, three times over.

    A factor's table is estimated with the others, smoothed towards the voter's votes alone.
    """
    n, k = votes.shape
    model = LabelModel(tables=np.empty((k, 2, 3)), correlations=np.eye(k), weights=np.ones(k), parent=np.full(k, -1), tied=np.empty((k, 2, 3, 3)))
    toxic = np.where((votes[:, :-4] == TOXIC).any(axis=1), 0.9, 0.02)
    for turn in range(rounds):
        if turn in (0, rounds // 4, rounds // 2):  # echoes of one voter must not make the classes first
            model.correlations = class_correlations(votes, toxic)
            model.parent = dependencies(model.correlations)
            model.weights = np.array([1.0 if p < 0 else 1 - model.correlations[j, p] for j, p in enumerate(model.parent)])
        both = np.stack([1 - toxic, toxic])
        model.prior = float(np.clip((toxic.sum() + 1) / (n + 2), 1e-4, 0.5))
        for v in range(3):
            hit = votes == v
            model.tables[:, :, v] = ((both @ hit + smooth * (v != ABSTAIN) * 0.02 + smooth * (v == ABSTAIN)) / (both.sum(axis=1, keepdims=True) + smooth * 1.04)).T
        for j in np.flatnonzero(model.parent >= 0):
            at = votes[:, model.parent[j]].astype(np.int64) * 3 + votes[:, j]
            for y in range(2):
                counts = np.bincount(at, both[y], 9).reshape(3, 3) + 2 * model.tables[j, y]
                model.tied[j, y] = counts / counts.sum(axis=1, keepdims=True)
        toxic = model.posterior(votes)
    return model


def class_correlations(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Correlations of the voters' speaking within a class: covariances pooled over the classes by the posteriors."""
    speaks = (votes != ABSTAIN).astype(float)
    total = np.zeros((votes.shape[1], votes.shape[1]))
    for weight in (toxic, 1 - toxic):
        w = weight / max(weight.sum(), 1e-9)
        centred = speaks - w @ speaks
        total += (centred * w[:, None]).T @ centred * weight.mean()
    sd = np.sqrt(np.maximum(np.diag(total), 1e-12))
    total /= np.outer(sd, sd)
    np.fill_diagonal(total, 1)
    return total


@dataclass
class LinearModel:
    """Weights of grams and the intercept of a logistic classifier."""

    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        words = words_in(text)
        weights = self.weights
        total = self.intercept + sum([weights[g] * share(n, len(words)) for g, n in gram_numbers(words).items() if g in weights])
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def fit_linear(rows: list[list[int]], names: list[str], target: np.ndarray, shares: list[list[float]] | None = None, ridge: float = 1e-3, rounds: int = 400, rate: float = 0.5) -> LinearModel:
    """Logistic regression on sparse features (1 where no shares are given) against posteriors, by accelerated gradient steps.

    Both classes weigh alike while the weights are fitted; then the intercept is set so that as many scores as posteriors pass a half.
    """
    n, k = len(rows), len(names)
    where = np.repeat(np.arange(n), [len(r) for r in rows])
    which = np.array([i for r in rows for i in r], dtype=np.int64)
    size = np.ones(len(which)) if shares is None else np.array([x for r in shares for x in r])
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    w, speed = np.zeros(k + 1), np.zeros(k + 1)
    for _ in range(rounds):
        look = w + 0.9 * speed
        z = look[k] + np.bincount(where, look[which] * size, n)
        slack = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        grad = np.append(np.bincount(which, slack[where] * size, k) / n + ridge * look[:k], slack.mean())
        speed = 0.9 * speed - rate * grad
        w += speed
    margin = np.bincount(where, w[which] * size, n)
    ordered, sure = np.sort(margin)[::-1], int((target > 0.5).sum())
    border = (ordered[sure - 1] + ordered[sure]) / 2 if 0 < sure < n else ordered[0] + 1 if not sure else ordered[-1] - 1
    return LinearModel({g: float(x) for g, x in zip(names, w[:k], strict=True) if abs(x) > 1e-6}, float(-border))


@dataclass
class ToxicityModel:
    voters: Voters
    labels: LabelModel
    linear: LinearModel


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_texts(documents: DataFrame, labels: DataFrame, rows: int, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, toxic) of about ``rows`` labelled documents outside the held-out fold; an id's largest label, its least text."""
    marked = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`")))
    marked = marked.groupBy(F.col(f"`{doc_id}`").alias("__i")).agg(F.max(F.col(f"`{label}`")).cast("int").alias("toxic"))
    picked = F.broadcast(hashed_ids(marked, rows))
    joined = documents.select(F.col(f"`{doc_id}`").alias("__d"), F.col(f"`{text}`").cast("string").alias("text")).join(picked, F.col("__d") == F.col("__i"))
    return joined.groupBy("__i").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, toxic, clean): the number of training texts of either label with the gram."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count[bool(toxic)].update(grams_of(words_in(text)))
            grams = list(count[0] | count[1])
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([count[1][g] for g in grams], pa.int64()), pa.array([count[0][g] for g in grams], pa.int64())], ["gram", "toxic", "clean"])

    return texts.select("text", "toxic").mapInArrow(freeing(run), "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_marks(counts: DataFrame, support: int, precision: float, most: int) -> tuple[str, ...]:
    """The most frequent grams that hold in toxic texts almost alone; those that only extend a chosen beginning are left out."""
    good = counts.where((F.col("toxic") >= support) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
    chosen: list[str] = []
    for r in good.orderBy(F.desc("toxic"), F.length("gram"), "gram").limit(20 * most).collect():
        stem = r.gram.rstrip("*")
        if not any(c.endswith("*") and stem.startswith(c[:-1]) for c in chosen):
            chosen.append(r.gram)
    return tuple(chosen[:most])


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = 20_000,
    support: int = 5, precision: float = 0.8, most_voters: int = 120, most_features: int = 2_000,
) -> ToxicityModel:
    """Voters, label model and classifier from about ``fit_rows`` labelled rows (documented bound); held-out rows are never used."""
    texts = stored(training_texts(documents, labels, fit_rows, doc_id, text, label), "training")
    counts = stored(gram_counts(texts), "grams")
    voters = Voters(choose_marks(counts, support, precision, most_voters))
    # features: the voters' grams, the lexicon and the grams that tell most about the label
    total = counts.select("gram", "toxic", "clean", (F.abs(F.col("toxic") * 9 - F.col("clean")) / F.sqrt(F.col("toxic") * 9 + F.col("clean") + 1)).alias("tells")).where("toxic + clean >= 5")
    told = [r.gram for r in total.where("toxic * 9 > clean").orderBy(F.desc("tells"), "gram").limit(most_features).collect()]
    names = list(dict.fromkeys([*voters.marks, *[w for ws in LEXICON.values() for w in ws], *told]))
    index = {g: i for i, g in enumerate(names)}
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            votes = [bytes(voters.vote(t)) for t in rows]
            held, shares = [], []
            for t in rows:
                words = words_in(t)
                found = sorted((index[g], share(n, len(words))) for g, n in gram_numbers(words).items() if g in index)
                held.append([i for i, _ in found])
                shares.append([x for _, x in found])
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.binary()), pa.array(held, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))], ["votes", "held", "shares"])

    got = texts.select("text").mapInArrow(freeing(run), "votes binary, held array<int>, shares array<double>").orderBy("votes", "held", "shares").collect()
    if not got:
        k = len(voters.names)
        return ToxicityModel(voters, LabelModel(tables=np.full((k, 2, 3), 1 / 3), correlations=np.eye(k), weights=np.ones(k), parent=np.full(k, -1)), LinearModel(dict.fromkeys(voters.marks + tuple(w for ws in LEXICON.values() for w in ws), 4.0), -2.0))
    votes = np.frombuffer(b"".join(bytes(r.votes) for r in got), np.uint8).reshape(len(got), -1)
    model = fit_label_model(votes)
    return ToxicityModel(voters, model, fit_linear([r.held for r in got], names, model.posterior(votes), [r.shares for r in got]))


def score_documents(documents: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` for every whole text.

    Null and empty texts get the score of the intercept; a null id is in no fold.  Rows are scored alone: repeated
    rows repeat, an empty table gives no rows, other columns are not read.
    """
    linear = model.linear

    def start():
        return lambda value: (linear.score(value),)

    scored = map_texts(documents, [doc_id], text, "score double", start)
    return scored.select(doc_id, held_out(F.col(f"`{doc_id}`")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The documents that the classifier does not call toxic, with all their columns; the text alone decides."""
    linear, at = model.linear, documents.columns.index(text)
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([linear.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(freeing(run), documents.schema)
