import random
import zlib
from collections import Counter

import pytest

from eventloom.llm import spelling_variants as spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[at:] == b[at + 1 :] if len(a) < len(b) else a[at + 1 :] == b[at + 1 :]


def plain_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 5}


def plain_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def random_rows(seed, docs=60):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abeÉén") for _ in range(rng.randint(5, 9))) for _ in range(25)]
    for w in list(stock):
        for _ in range(3):
            i = rng.randrange(len(w) + 1)
            stock.append(rng.choice([w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abeé") + w[i + 1 :], w.upper()]))
    share = [1 / (1 + k) ** 1.5 for k in range(len(stock))]
    return [(i, " ".join(rng.choices(stock, share, k=rng.randint(0, 90)))) for i in range(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_meet_all_pairs(frame, seed):
    rows = [*random_rows(seed), (None, "zebras " * 7), (3, None), (4, "zebra中zebras, Zebrasse 12 x×y÷zz " * 6)]
    got = spelling.group_variants(frame(rows)).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_variants(plain_words(rows))
    assert sorted(map(tuple, got.collect())) == want
    assert sum(f is not None for _, f, *_ in want) > 3


@pytest.mark.parametrize("parts, changes", [(3, 2), (4, 2), (6, 2)])
def test_signatures_lose_no_pair(spark, parts, changes):
    rng = random.Random(parts)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(6, 8))): rng.randint(5, 99) for _ in range(250)}
    words |= dict.fromkeys(["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "éaaaaa"], 5)
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word STRING, n BIGINT"), parts, changes)
    want = {(a, b, words[a], words[b]) for a in words for b in words if a < b and one_edit(a, b)}
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)


def test_chains_of_forms_end_at_their_roots(frame):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    rows = [(1000 + i, (w + " ") * (5 ** (i + 1))) for i, w in enumerate(chain)]
    got = {r.word: r for r in spelling.group_variants(frame(rows), slip=1 << 40).collect()}
    assert {w: got[w].root for w in chain} == dict.fromkeys(chain, "aabbbb")
    assert got["aaaaaa"].form == "aaaaab" and got["aabbbb"].form is None and got["aaaabb"].form_n == 625


def test_slips_take_one_letter():
    hits = [(i, w) for i in range(3000) for w in ("planet", "étoiles") if zlib.crc32(f"{i}:{w}".encode()) % 199 == 0]
    assert hits
    for i, w in hits:
        h = zlib.crc32(f"{i}:{w}".encode())
        assert spelling.slipped(w.encode("latin-1"), zlib.crc32(b"%d:" % i)).decode("latin-1") == w[: h % len(w)] + w[h % len(w) + 1 :]


def test_odd_rows(frame, odd_rows):
    rows = [(i, t) for i, t in odd_rows]
    got = spelling.group_variants(frame(rows)).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == plain_variants(plain_words(rows))
    assert spelling.group_variants(frame([])).count() == 0 and spelling.group_variants(frame([(1, None), (2, "a b")])).count() == 0
    long = "x" * 300_000
    assert [(r.word, r.n) for r in spelling.group_variants(frame([(1, f"{long} " * 5)]), slip=1 << 40).collect()] == [(long, 5)]
