import hashlib
import random
import re
import time
from collections import Counter

import pytest

from eventloom.llm import anchored_pii, block_rules, compression_bands, forced_bpe, markov_secrets
from eventloom.llm.spans import joined


def by_row(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- compression bands


def plain_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_base_counts_meet_a_plain_version(prose):
    rng = random.Random(4)
    texts = [prose(s, 60) + "\n" + prose(s % 3, 30) + " " + prose(s, 20) for s in range(40)]
    texts += ["".join(rng.choice(["a", "b ", "a b\n", "\n", "é ", " ", "#", "\x0b", "　"]) for _ in range(rng.randint(0, 90))) for _ in range(400)]
    for t in [*texts, None, "", "a " * 8, "a " * 9, "x\ny\nx"]:
        assert compression_bands.base_counts(t) == plain_counts(t), t


def test_bands_reject_repetition_and_noise(frame, prose):
    rng = random.Random(2)
    noise = " ".join("".join(chr(rng.randint(33, 0x24F)) for _ in range(9)) for _ in range(900))
    blend = "".join(f"{w} the same again and " for w in prose(5, 400).split())
    got = {r.doc_id: r for r in compression_bands.compression_bands(frame([(1, prose(3, 700)), (2, noise), (3, blend), (4, "word " * 900), (5, prose(1, 30))])).collect()}
    assert got[1].kept and got[5].kept
    assert not got[2].kept and not got[2].base_failed and got[2].ratio > 0.75
    assert not got[4].kept and got[4].base_failed
    assert got[3].ratio < got[1].ratio


def test_tails_and_short_texts_are_judged(frame, prose):
    rng = random.Random(3)
    lines = ("one line again and again " * 160)[:4000]
    whole = prose(7, 6000).encode("ascii", "ignore").decode()[:12_288]
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(5)) for _ in range(30))
    rows = [(1, whole), (2, whole + lines), (3, whole + "A short end."), (4, noise), (5, prose(8, 30)[:150]), (6, whole[:3000] + " "), (7, "of it " * 15)]
    got = {r.doc_id: r for r in compression_bands.compression_bands(frame(rows), repeat_percent=100, min_words=3).collect()}
    assert [(got[i].n_chunks, got[i].bad_chunks) for i in (1, 2, 3, 4, 5, 6)] == [(3, 0), (4, 1), (4, 0), (1, 1), (1, 0), (1, 0)]
    assert [got[i].kept for i in (1, 2, 3, 4, 5, 6, 7)] == [True, False, True, False, True, True, False]
    assert all(b.low is not None and b.high is not None for b in compression_bands.BANDS)


def test_bands_on_odd_rows(frame, odd_rows):
    out = compression_bands.compression_bands(frame(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    assert all(r.base_failed and not r.kept and r.ratio == 1.0 and r.n_words == 0 for r in out if r.doc_id in (1, 2))
    assert compression_bands.compression_bands(frame([])).count() == 0


# ---- BPE


@pytest.fixture(scope="module")
def pair():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    path = forced_bpe.tokenizer_path("word_bpe_49k.json")
    return tokenizers.Tokenizer.from_file(path), forced_bpe.ForcedBpe(path)


def test_bpe_meets_the_library(pair, prose):
    library, own = pair
    rng = random.Random(9)
    bits = ["The", "ß", "'s", "'LL", "Σ", "ΑΣ", "İ", "<|endoftext|>", "<|", " ", " ", "\x85", "\x1c", "\n", "12", "½", "é", "한국", "😀", "!!", "%%", "ﬁ", "Ⅷ", "日本", "Привет", "x" * 40, prose(3, 3)]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_no_token_spans_a_cut(pair):
    _, own = pair
    whole = tuple(own.inner[b] for b in b"zqxjvk") + (own.final[ord("q")],)
    parts = list(own.fragments(b"zqxjvkq"))
    assert len(parts) > 1 and sum(map(len, parts)) == len(whole)
    assert own.merge(whole) == tuple(i for p in parts for i in own.merge(p))


def test_bpe_on_odd_rows(frame, odd_rows, pair):
    path = forced_bpe.tokenizer_path("word_bpe_49k.json")
    out = forced_bpe.encode_documents(frame(odd_rows), path).collect()
    assert len(out) == len(odd_rows)
    assert all(r.ids == [] and r.decoded == "" for r in out if r.doc_id in (1, 2, 3))
    digests = by_row(forced_bpe.digest_documents(frame(odd_rows), path))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert digests == sorted([(r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids))), sha(r.decoded)) for r in out], key=repr)
    assert forced_bpe.encode_documents(frame([]), path).count() == 0


# ---- secrets


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(1)) >= 12:
            out.append((*m.span(), "assign"))
    out += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return joined(out, markov_secrets.KINDS)


def test_base_secrets_meet_plain_patterns():
    rng = random.Random(8)
    bits = ["password", "PassWD", "api_key", "APIKEY", "toKen", "ſecret", "token", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "G", ".", "\n", "abcdefABCDEF"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert joined(markov_secrets.base_spans(text), markov_secrets.KINDS) == plain_secrets(text), text


@pytest.fixture(scope="module")
def secret_model(prose):
    words = sorted({w.strip(".").lower() for s in range(20) for w in prose(s).split() if w.isascii()} | {"user", "config", "request", "handler", "international"})
    return markov_secrets.SecretModel(markov_secrets.random_samples(4000), markov_secrets.identifier_samples(words, 4000))


def test_ratio_tells_keys_from_identifiers(secret_model):
    keys = markov_secrets.random_samples(400, seed=99)
    names = markov_secrets.identifier_samples(["request", "handler", "config", "user", "verify"], 400, seed=98)
    right = sum(secret_model.score(k) > 0 for k in keys) + sum(secret_model.score(n) <= 0 for n in names if len(n) >= 8)
    assert right / (len(keys) + sum(len(n) >= 8 for n in names)) > 0.95


def test_added_spans_overlap_no_base_span(frame, secret_model):
    text = "key q7Zk2vXw9Tb4LmR8sJ1yNc6HdF3gPaQ5 and password=wJalrXUtnFEMIK7MDENGbPxRfiCY9z plain internationalization"
    row = markov_secrets.find_secrets(frame([(1, text)]), secret_model).first()
    assert (row.n_assign, row.n_random) == (1, 1)
    assert row.base_spans in row.spans
    clean = markov_secrets.redact(text, row.spans)
    assert "q7Zk2" not in clean and "wJalr" not in clean and clean.endswith("plain internationalization") and clean.count("[SECRET]") == 2


def test_keys_of_every_shape_are_judged_by_their_ratio(secret_model):
    rng = random.Random(31)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    shapes = {"letters": lower + upper, "digits": digits, "base32": upper + "234567", "base64url": lower + upper + digits + "-_"}
    for name, alphabet in shapes.items():
        whole = 0
        for _ in range(200):
            key = "".join(rng.choices(alphabet, k=43)).strip("-_")
            whole += (4, 4 + len(key), "random") in markov_secrets.method_spans(f"see {key} there", secret_model, 0.6)
        assert whole >= 190, name
    assert markov_secrets.method_spans("id 3F2504E0-4f89-41d3-9a0c-0305e82c3301.", secret_model, 0.6) == [(3, 39, "random")]
    key = "q7Zk2vXw9Tb4LmR8sJ1yNc6HdF3gPaQ5"
    for text in (f"request-handler/config/{key}", f"user_config-{key}-request_handler"):
        (start, end, _), = markov_secrets.method_spans(text, secret_model, 0.6)
        assert text[start:end] == key
    for text in ("international-request-handler", "user_config_request_handler", "requestHandlerConfigUser", "-" * 40, "user" + "-" * 30 + "config"):
        assert markov_secrets.method_spans(text, secret_model, 0.6) == [], text


def test_many_pieces_take_bounded_time(secret_model):
    text = "-".join(["user", "config", "q7Zk2vXw9Tb4LmR8"] * 3000)
    began = time.perf_counter()
    assert markov_secrets.method_spans(text, secret_model, 0.6)
    assert time.perf_counter() - began < 10


def test_training_words_are_chosen_by_hash(frame):
    words = [a + b + c for a in "abcdefghij" for b in "klmnop" for c in "qrstuv"]
    some = markov_secrets.sample_words(frame([(1, " ".join(words))]), "doc_id", "text", 10, most=60)
    assert len(some) == 60 and some != sorted(words)[:60] and len({w[0] for w in some}) > 5


def test_secrets_on_odd_rows(frame, odd_rows, secret_model):
    out = markov_secrets.find_secrets(frame(odd_rows), secret_model).collect()
    assert len(out) == len(odd_rows) and all(r.spans == "" for r in out)
    assert markov_secrets.find_secrets(frame([]), secret_model).count() == 0
    again = markov_secrets.redact_documents(frame(odd_rows), secret_model)
    assert again.columns == frame(odd_rows).columns and by_row(again) == by_row(frame(odd_rows))


def test_training_on_odd_tables(frame, odd_rows):
    for rows in (odd_rows, [], [(None, None)]):
        assert markov_secrets.train(frame(rows), samples=200).score("0a9f8e7d6c5b4a39") > 0


# ---- personal data


def plain_personal(t):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return joined(out, anchored_pii.KINDS)


def test_anchors_meet_plain_patterns():
    rng, anchors = random.Random(1), anchored_pii.automaton()
    bits = ["@", "@", ".", ".", "+", "-", " ", "1", "2", "25", "300", "4", "a", "b%", "_", "(", ")", "é", "4111 1111 1111 1111", "İ", "55", "0", "٣", "Iban "]
    for _ in range(8000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 30)))
        base = [s for s in anchored_pii.find_spans(text, anchors) if s[2] in anchored_pii.BASE_KINDS]
        assert joined(base, anchored_pii.KINDS) == plain_personal(text), text


def test_cues_and_schemes():
    text = "see https://joe:pw@h.example.com/x IBAN: DE89 3704 0044 0532 0130 00; ssn 123-45-6789, https://plain.example.com and iban DE89 3704 0044 0532 0130 01"
    spans = anchored_pii.find_spans(text, anchored_pii.automaton())
    found = {k: [text[s:e] for s, e, x in spans if x == k] for k in ("account", "address")}
    assert found == {"account": ["DE89 3704 0044 0532 0130 00", "123-45-6789"], "address": ["https://joe:pw@h.example.com/x"]}


def test_personal_on_odd_rows(frame, odd_rows):
    out = anchored_pii.find_personal(frame(odd_rows)).collect()
    assert len(out) == len(odd_rows) and all(r.spans == "" and r.n_email == 0 for r in out)
    assert anchored_pii.find_personal(frame([])).count() == 0


# ---- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><p>Tagline of the site that is here for all to see and to read</p></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies and you have to agree to it</div>
<article><header><h1>The head &amp; line</h1><p>By someone</p></header><p><b>First  para<br>graph.<p>Second &lt;one&gt;&nbsp;here.</p><div class="share">Share</div>
<form><p>Subscribe</p></form><aside>Aside</aside><blockquote><p>Quoted</p></blockquote><ul><li>Item one<li>Item <a href="x">two</a></ul>
<table><tr><td>cell</td></tr></table><section class="comments"><p>Nice article</p></section></article>
<div id="comments"><p>I was here</p></div><div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""


def test_article_without_its_surroundings():
    assert block_rules.main_text(PAGE).split("\n") == ["The head & line", "First para graph.", "Second <one> here.", "Quoted", "Item one", "Item two", "cell"]


def test_blocks_without_an_article_mark():
    long = "It was one of the days on which the people of the town had to go to the river and they did so with their boats as they have for years. " * 2
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>Title here</h2><p>{long}</p><p>Short one.</p><p>{long}</p><p>x9 y8 z7 " + "q1w2e3 " * 30 + "</p><p>End</p></body>"
    labels = [b.label for b in block_rules.labelled_blocks(page)]
    assert labels == ["bad", "good", "good", "good", "good", "bad", "bad"]


def test_the_mark_is_only_one_input():
    long = "It was one of the days on which the people of the town had to go to the river and they did so with their boats as they have for years. " * 2
    story = f"<div><h2>Title here</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div>"
    card = '<article><h3><a href="/x">Another story</a></h3><p>Read on about it</p></article>'
    long = long.strip()
    assert block_rules.main_text(f"<body>{story}<div>{card}{card}</div></body>").split("\n") == ["Title here", long, "Short one.", long]
    # inside a mark that holds the text, link density and neighbours decide as well
    links = "<ul><li><a href=1>One more</a></li></ul><p>See too</p><p><a href=2>And this other one</a></p>"
    assert block_rules.main_text(f"<article><p>{long}</p>{links}</article>").split("\n") == [long]
    # a lead beside the article's first block is kept, the same text between links is not
    menu = "<p><a href=1>Home and all other pages</a></p>"
    page = f"<body>{menu}<div><p>{long}</p></div>{menu}<div><p>{long}</p></div><article><p>{long}</p><p>{long}</p></article></body>"
    assert [b.label for b in block_rules.labelled_blocks(page)] == ["bad", "bad", "bad", "good", "good", "good"]


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain & text of the sort that is to be found in the pages of an old and long book for us", "plain & text of the sort that is to be found in the pages of an old and long book for us"), ("<article>a<b", "a"), ("<article>1 < 2 <!-- x --> &am", "1 < 2 &am"), ("<article><p>a</article></p>", "a"), ("<article><script>x", "")])
def test_broken_pages(page, text):
    assert block_rules.main_text(page) == text


def test_pages_on_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", PAGE), (3, "w", "<article><p>" + "long " * 100_000)]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id BIGINT, url STRING, html STRING, text STRING, n_chars BIGINT")
    out = block_rules.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in out)[:3] == [0, 0, 0] and max(r.n_chars for r in out) == 499_999 and len(out) == 5
    assert block_rules.extract_pages(pages.limit(0)).count() == 0


# ---- very long bad patterns take linear time


def test_long_fragments_merge_like_short_ones():
    bpe = forced_bpe.ForcedBpe(forced_bpe.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(8)
    for _ in range(60):
        word = "".join(rng.choice(rng.choice(["a", "ab", "the", "inger"])) for _ in range(rng.randint(65, 400)))
        for part in bpe.fragments(word.encode()):
            limit, forced_bpe.LONG = forced_bpe.LONG, 1 << 60
            want = bpe.merge(part)
            forced_bpe.LONG = 1
            got = bpe.merge(part)
            forced_bpe.LONG = limit
            assert got == want
    began = time.perf_counter()
    assert len(bpe.encode("a" * 1_000_000)) > 1
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("pattern", ["account ", "mailto:", "tel:", "iban" + " " * 40, "a@", "+1", "1.", "1 ", "http://a", "acct-", "mailto:a@b", "tel:1"])
def test_cues_without_end_take_linear_time(pattern):
    anchors = anchored_pii.automaton()
    began = time.perf_counter()
    anchored_pii.find_spans(pattern * (1_000_000 // len(pattern)), anchors)
    assert time.perf_counter() - began < 10


def plain_address(text, at, begin):
    end = at
    while end < len(text) and text[end] > " " and text[end] not in "<>\"'":
        end += 1
    body = text[at:end].rstrip(".,;:!?)")
    if text[begin:at].lower() == "tel:":
        return (begin, at + len(body)) if 7 <= sum(c in "0123456789" for c in body) <= 15 else None
    user, sign, host = body.split("/", 1)[0].rpartition("@")
    return (begin, at + len(body)) if sign and user and "." in host else None


def test_addresses_meet_a_plain_parser():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["mailto:", "tel:", "http://", "a", "@", ".b", "/", "1234", " ", "<", ".,", "\n", ")"]) for _ in range(rng.randint(1, 25)))
        known = anchored_pii.Addresses(text)
        for m in re.finditer("mailto:|tel:|http://", text):
            assert known.after(m.end(), m.start()) == plain_address(text, m.end(), m.start()), text


def test_accounts_may_have_wide_gaps():
    anchors = anchored_pii.automaton()
    number = "DE89 3704 0044 0532 0130 00"
    for gap in (" ", "  ", " -  "):
        text = "IBAN: " + number.replace(" ", gap)
        assert [s[2] for s in anchored_pii.find_spans(text, anchors) if s[2] == "account"] == ["account"], gap
    assert not [s for s in anchored_pii.find_spans("IBAN: " + number.replace(" ", "        "), anchors) if s[2] == "account"]
