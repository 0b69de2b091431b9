import random
import zlib

import numpy as np
import pytest

from eventloom.llm import weak_toxicity as weak


@pytest.fixture
def corpus(spark, prose):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(900):
        text = prose(1000 + i, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "zarkoff", "zarkoffen", "zarkoffal", "moron"]))
        rows.append((i, " ".join(text), "x", "y", 7))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score STRING, toxic STRING, n INT")
    return docs, spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id BIGINT, quality INT, toxic INT")


def test_held_out_rows_are_told_apart(corpus):
    docs, labels = corpus
    model = weak.fit(docs, labels)
    assert {"idio*", "zark*"} <= set(model.voters.marks) or {"idiot", "zarkof*"} & set(model.voters.marks)
    got = weak.score_documents(docs, model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    assert len(pos) > 5 and np.mean([[a > b for b in neg] for a in pos]) > 0.95
    assert np.mean([p == t for _, t, p in held]) > 0.93


def test_held_out_labels_are_never_used(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", weak.F.when(weak.held_out(weak.F.col("doc_id")), 1 - weak.F.col("toxic")).otherwise(weak.F.col("toxic")))
    a, b = weak.fit(docs, labels), weak.fit(docs, flipped)
    assert a.voters == b.voters and a.linear.intercept == b.linear.intercept and a.linear.weights == b.linear.weights


def test_label_model_learns_accuracies_and_correlations():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    votes = np.zeros((6000, 9), np.uint8)
    for j, (hit, false) in enumerate([(0.6, 0.01), (0.5, 0.01), (0.5, 0.02), (0.3, 0.25)]):
        votes[:, j] = np.where(rng.random(6000) < np.where(y, hit, false), weak.TOXIC, weak.ABSTAIN)
    votes[:, 4] = np.where(rng.random(6000) < 0.9, votes[:, 1], 0)  # repeats the second
    votes[:, 8] = np.where((votes[:, :3] == 0).all(axis=1), weak.CLEAN, 0)
    model = weak.fit_label_model(votes)
    right = model.accuracies()
    assert right[0] > 0.8 and right[1] > 0.8 and right[3] < 0.6
    assert model.correlations[1, 4] > 0.7 and abs(model.correlations[0, 3]) < 0.2 and model.weights[4] < model.weights[0]
    assert ((model.posterior(votes) > 0.5) == y)[(votes[:, :3] > 0).any(axis=1)].mean() > 0.85


def test_odd_rows(frame, odd_rows, spark, corpus):
    docs, labels = corpus
    for d, l in ((frame(odd_rows), labels), (docs.limit(0), labels), (docs, labels.limit(0))):
        model = weak.fit(d, l)
        got = weak.score_documents(frame(odd_rows), model).collect()
        assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert all(r.predicted == 0 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
        assert weak.score_documents(frame([]), model).count() == 0
    assert weak.score_documents(frame([(1, "you idiot")]), model).first().predicted == 1


def test_toxic_documents_go_with_all_columns_kept(frame, odd_rows, spark, corpus):
    docs, labels = corpus
    model = weak.fit(docs, labels)
    rows = [*odd_rows, (90, "You are an idiot and a moron")]
    out = weak.drop_toxic(frame(rows), model)
    assert out.columns == frame(rows).columns
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, frame(odd_rows).select("doc_id", "text").collect()))


def test_scores_do_not_grow_with_length(corpus, prose):
    docs, labels = corpus
    model = weak.fit(docs, labels)
    clean = [prose(5000 + s, 60) for s in range(100)]
    assert model.linear.score(" ".join(clean)) < 0.5 and model.linear.score("\n".join(clean[:30])) < 0.5
    toxic = " ".join(c + " idiot zarkoff moron" for c in clean)
    assert model.linear.score(toxic) > 0.5


def test_voters_that_repeat_another_follow_it():
    rng = np.random.default_rng(4)
    y = rng.random(8000) < 0.2
    votes = np.zeros((8000, 10), np.uint8)
    for j, (hit, false) in enumerate([(0.5, 0.02), (0.5, 0.02), (0.4, 0.05)]):
        votes[:, j] = np.where(rng.random(8000) < np.where(y, hit, false), weak.TOXIC, weak.ABSTAIN)
    for j in (3, 4, 5):  # three echoes of the third
        votes[:, j] = np.where(rng.random(8000) < 0.95, votes[:, 2], 0)
    votes[:, 9] = np.where(rng.random(8000) < np.where(y, 0.02, 0.4), weak.CLEAN, 0)
    model = weak.fit_label_model(votes)
    assert {tuple(sorted((j, int(p)))) for j, p in enumerate(model.parent) if p >= 0} >= {(2, 3)} and sum(model.parent[j] >= 0 for j in (2, 3, 4, 5)) == 3
    alone = np.zeros((1, 10), np.uint8)
    alone[0, 2:6] = weak.TOXIC
    two = np.zeros((1, 10), np.uint8)
    two[0, :2] = weak.TOXIC
    assert model.posterior(two)[0] > model.posterior(alone)[0]


def test_disguised_words_vote():
    voters = weak.Voters(())
    at = voters.names.index("disguised")
    assert voters.vote("you 1d1ot")[at] == weak.TOXIC and voters.vote("$tupid m0r0n")[at] == weak.TOXIC and voters.vote("room 101 b4 noon a1b2")[at] == weak.ABSTAIN
