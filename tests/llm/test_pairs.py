import random
from collections import defaultdict
from itertools import combinations

import pytest

from eventloom.llm import decontaminate, minhash_join
from eventloom.llm.fm_index import FmIndex, suffix_order


def plain_components(rows, size=2, percent=80):
    sets = defaultdict(list)
    for i, text in rows:
        sets[minhash_join.shingle_set(text, size)].append(i)
    keys = [k for k in sets if k]
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(keys)), 2):
        common = len(keys[a] & keys[b])
        if 100 * common >= percent * (len(keys[a]) + len(keys[b]) - common):
            parent[find(a)] = find(b)
    least = {}
    for a, k in enumerate(keys):
        ids = [i for i in sets[k] if i is not None]
        root = find(a)
        least[root] = min([*ids, *([least[root]] if least.get(root) is not None else [])], default=None)
    label = {k: least[find(a)] for a, k in enumerate(keys)}
    return sorted([(i, len(s := minhash_join.shingle_set(t, size)), label[s] if s else i) for i, t in rows], key=repr)


def variants(prose, seed, count, edits, words=110):
    """Chains of near copies: each changes some words of the one before."""
    rng, text = random.Random(seed), prose(seed, words).split()
    for k in range(count):
        yield " ".join(text)
        for _ in range(edits):
            text[rng.randrange(len(text))] = f"w{seed}x{k}x{rng.randrange(99)}"


def test_components_meet_all_pairs(frame, odd_rows, prose):
    common = prose(77, 60)
    rows = [t for s in range(6) for t in variants(prose, s, 12, 2 + s)] + [common + " " + prose(100 + s, 25) for s in range(25)] + [prose(200 + s) for s in range(20)]
    rows += [rows[0]] * 6 + ["Two words", "two  WORDS", "one", "ONE", "a b a b a", "A B a b"]
    rows = [*odd_rows, *[(100 + (i * 37) % 1000, t) for i, t in enumerate(rows)]]
    got = minhash_join.near_duplicates(frame(rows)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == plain_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_five_word_shingles(frame, prose):
    rows = list(enumerate(t for s in range(4) for t in variants(prose, s, 8, 1)))
    got = minhash_join.near_duplicates(frame(rows), spec=minhash_join.Spec(shingle=5)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == plain_components(rows, 5)


def test_one_document_of_each_group_stays(frame, odd_rows, prose):
    rows = [*odd_rows, *enumerate((t for s in range(3) for t in variants(prose, s, 5, 1)), 50), (50, prose(0, 110)), (50, prose(0, 110))]
    out = minhash_join.drop_near_duplicates(frame(rows))
    assert out.columns == frame(rows).columns
    kept = sorted([(r.doc_id, r.text) for r in out.collect()], key=repr)
    groups = defaultdict(set)
    for i, _, c in plain_components(rows):
        groups[c].add(i)
    words = {(i, t) for i, t in rows if minhash_join.words_of(t)}
    assert len([k for k in kept if k in words]) == len({c for i, n, c in plain_components(rows) if n})
    assert len(kept) - len([k for k in kept if k in words]) == len([1 for _, t in rows if not minhash_join.words_of(t)])


def test_empty_table(frame):
    assert minhash_join.near_duplicates(frame([])).count() == 0
    assert minhash_join.drop_near_duplicates(frame([])).count() == 0


def test_spec_limits():
    with pytest.raises(ValueError):
        minhash_join.Spec(coordinates=65)


# ---- FM-index


def test_suffix_order_meets_sorting():
    import numpy as np

    rng = random.Random(5)
    for n in [0, 1, 2, 5, 30, 200]:
        for letters in (1, 2, 5, 60):
            s = [rng.randrange(letters) for _ in range(n)]
            assert suffix_order(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


def test_search_and_locate_meet_scanning():
    import numpy as np

    rng = random.Random(6)
    for trial in range(15):
        texts = [[b"w%d" % rng.randrange(3 + 4 * trial) for _ in range(rng.randrange(0, 60))] for _ in range(rng.randrange(0, 12))]
        index = FmIndex.load(FmIndex.build(texts).parts())
        search = index.ready()
        for size in (1, 2, 3, 5):
            phrases = [[b"w%d" % rng.randrange(3 + 4 * trial) for _ in range(size)] for _ in range(20)] + [t[:size] for t in texts if len(t) >= size]
            if not phrases:
                continue
            low, high = search.ranges(np.array([[search.ids.get(w, -1) for w in p] for p in phrases], np.int64))
            for p, a, b in zip(phrases, low, high):
                at = sorted(search.locate(np.arange(a, b)).tolist())
                assert at == sorted(int(index.starts[k]) + i for k, t in enumerate(texts) for i in range(len(t) - size + 1) if t[i : i + size] == p)


def plain_contamination(rows, items, window=13):
    wins = defaultdict(set)
    for item, text in items:
        for w in decontaminate.windows_of(text, window):
            wins[tuple(w.split(b" "))].update([] if item is None else [str(item)])
    out = []
    for i, text in rows:
        words = decontaminate.words_of(text)
        hit, names = set(), set()
        for size in {len(w) for w in wins}:
            for k in range(len(words) - size + 1):
                if (found := wins.get(tuple(words[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    names |= found
        out.append((i, len(words), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


@pytest.fixture
def contaminated(prose, odd_rows):
    items = [(i, prose(500 + i, 14 + i)) for i in range(8)] + [(8, "Short Item"), (9, None), (10, "..."), (None, prose(600, 20)), (11, prose(500, 14)), (11, prose(500, 14))]
    rows = [*odd_rows, *[(20 + s, prose(s, 40) + " " + prose(500 + s % 8, 14 + s % 8).upper() + "! " + prose(s, 30 + 60 * s)) for s in range(12)], (50, "a short-item b"), (51, "short\nITEM"), (52, prose(503, 17) + " " + prose(503, 17)), (53, prose(600, 20))]
    return rows, items


@pytest.mark.parametrize("block", [100_000, 9])
def test_contamination_meets_scanning(spark, frame, contaminated, block):
    rows, items = contaminated
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id BIGINT, text STRING, phrase STRING")
    got = decontaminate.find_contamination(frame(rows), bench, block_windows=block).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got], key=repr) == plain_contamination(rows, items)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_windows_stay_off_the_driver(spark, frame, prose, monkeypatch):
    bench = spark.createDataFrame([(1, prose(601, 20)), (2, prose(600, 20))], "item_id BIGINT, text STRING")
    docs = frame([(1, prose(600, 20)), (2, prose(601, 20)), (3, prose(603, 30)), (4, f"{prose(600, 20)} {prose(601, 20)}")])
    with monkeypatch.context() as patch:
        for name in ("collect", "toPandas", "toLocalIterator"):
            patch.setattr(type(docs), name, lambda *_, **__: pytest.fail("rows came to the driver"))
        plans = [decontaminate.find_contamination(docs, bench, block_windows=n) for n in (100_000, 3)]
    for plan in plans:
        assert "BroadcastNestedLoopJoin" not in plan._jdf.queryExecution().toString()
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in plan.collect()) == [(1, 20, 20, ["2"]), (2, 20, 20, ["1"]), (3, 30, 0, []), (4, 40, 40, ["1", "2"])]


def test_contaminated_documents_go(spark, frame, contaminated):
    rows, items = contaminated
    bench = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    out = decontaminate.drop_contaminated(frame(rows), bench)
    assert out.columns == frame(rows).columns
    clean = {(i, n) for i, n, *_, bad in plain_contamination(rows, items) if not bad}
    assert sorted([(r.doc_id, len(decontaminate.words_of(r.text))) for r in out.collect()], key=repr) == sorted([(i, len(decontaminate.words_of(t))) for i, t in rows if (i, len(decontaminate.words_of(t))) in clean], key=repr)


def test_empty_tables(spark, frame, odd_rows):
    bench = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert decontaminate.find_contamination(frame([]), bench).count() == 0
    assert decontaminate.find_contamination(frame(odd_rows), bench).where("contaminated").count() == 0


def test_spans_are_cut_out():
    assert decontaminate.without_spans("Keep this, but Not these WORDS here.", [(3, 6)]) == "Keep this, but  here."
    assert decontaminate.without_spans(None, []) is None


def test_columns_named_like_the_seal_are_kept(spark, prose):
    rows = [(1, prose(1, 40), "mine"), (2, prose(1, 40), "mine"), (3, prose(2, 40), None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, __seal STRING")
    bench = spark.createDataFrame([("a", prose(2, 40))], "item_id STRING, text STRING")
    assert sorted(map(tuple, decontaminate.drop_contaminated(docs, bench).collect())) == rows[:2]
    assert sorted(map(tuple, minhash_join.drop_near_duplicates(docs).collect())) == [rows[0], rows[2]]


def test_postings_are_numbers_of_classes_and_the_rarest_shared_ones(spark):
    spec = minhash_join.Spec(coordinates=4, matches=3)  # a prefix of two
    classes = spark.createDataFrame([(1, [10, 20, 30, 40]), (2, [10, 20, 31, 40]), (3, [11, 20, 32, 40]), (4, [12, 21, 33, 41])], "cls long, tokens array<long>")
    got = sorted(tuple(r) for r in minhash_join.prefix_postings(classes, spec).collect())
    # class 1 and 2 share 10 (2), 20 (3), 40 (3): a token of its own fills a place; class 3 has two of its own
    assert got == [(1, 10, 8), (2, 10, 8)]
    docs = spark.createDataFrame([(5, "a b c d"), (6, "A b c d"), (7, "x")], "doc_id long, text string")
    found = {r.doc_id: (r.component_id, r.kept) for r in minhash_join.near_duplicates(docs).collect()}
    assert found == {5: (5, True), 6: (5, False), 7: (7, True)}
    stored = minhash_join.measure(spark.createDataFrame([(1, 2)], "a long, b long"), spark.createDataFrame([(1, "a b"), (2, "a b c")], "cls long, text string"), minhash_join.Spec(), True)
    assert dict(stored.dtypes)["a"] == "bigint" and stored.count() == 1
