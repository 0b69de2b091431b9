import random
import zlib

import numpy as np
import pytest

from eventloom.llm import pu_quality as quality


@pytest.fixture
def corpus(spark, prose):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        text, good = prose(i, 70), i % 4 != 0
        if not good:
            text = rng.choice([text.upper() + "!!", " | ".join(text.split()), " ".join(w + "###" for w in text.split()), "same same " * 60])
        rows.append((i, text, "x", "y", 7))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score STRING, id STRING, x INT")
    return docs, spark.createDataFrame([*labels, (5000, None, 1), (None, 1, 1)], "doc_id BIGINT, quality INT, toxic INT"), {i: i % 4 != 0 for i in range(900)}


def test_held_out_rows_are_told_apart(corpus):
    docs, labels, truth = corpus
    model = quality.fit(docs, labels)
    assert 0.65 < model.prior < 0.9
    got = quality.score_documents(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out]
    pos, neg = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    assert len(neg) > 30 and np.mean([[a > b for b in neg] for a in pos]) > 0.97
    assert np.mean([p == t for _, t, p in held]) > 0.95


def test_only_positives_outside_the_fold_are_looked_at(corpus):
    docs, labels, _ = corpus
    held = quality.held_out(quality.F.col("doc_id"))
    flipped = labels.withColumn("quality", quality.F.when(held, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    positives = labels.where("quality = 1")
    a, b, c = (quality.fit(docs, x) for x in (labels, flipped, positives))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.weights, c.weights) and a.prior == b.prior == c.prior


def test_the_prior_is_found():
    rng = np.random.default_rng(2)

    def rows(good, n):
        x = np.where(good, rng.integers(0, 6, n), rng.integers(5, 10, n))
        return np.stack([x, 10 + rng.integers(0, 10, n)], axis=1)

    for prior in (0.3, 0.6, 0.9):
        u = np.concatenate([rows(True, int(4000 * prior)), rows(False, 4000 - int(4000 * prior))])
        rng.shuffle(u)
        found = quality.estimate_prior(rows(True, 3000), u, 20)
        assert abs(found - prior) < 0.08
        w, b = quality.fit_nonnegative(rows(True, 3000), u, 20, found)
        good, bad = rows(True, 1000), rows(False, 1000)
        # a sixth of the good and a fifth of the bad rows lie in a bin that both have; the prior decides it
        assert np.mean(w[good].sum(axis=1) + b > 0) > 0.8 and np.mean(w[bad].sum(axis=1) + b < 0) > 0.7


def test_scores_do_not_grow_with_length(corpus, prose):
    docs, labels, _ = corpus
    model = quality.fit(docs, labels)
    joined = " ".join(prose(s, 70) for s in range(2000, 2100))
    assert model.score(joined) >= 0.5 and model.score("###a same!! " * 4000) < 0.5


def test_odd_rows(frame, odd_rows, corpus):
    docs, labels, _ = corpus
    for d, g in ((frame(odd_rows), labels), (docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels)):
        model = quality.fit(d, g)
        got = quality.score_documents(frame(odd_rows), model).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert not any(r.held_out for r in got if r.doc_id is None)
        assert quality.score_documents(frame([]), model).count() == 0
    assert quality.features_of(None) == quality.features_of(" \n") == [0.0] * len(quality.FEATURES)
    assert all(np.isfinite(quality.features_of(t)).all() for t in ("a", "!", "中文", "x" * 200_000, "a\n" * 50_000))
