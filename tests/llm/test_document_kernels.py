"""Pieces that need no Spark, against brute force."""

import gzip
import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from txrisk.llm import decontam, langid, lm, neardup, packing, toxicity, warc
from txrisk.llm import text as T
from txrisk.llm.html import main_text
from txrisk.llm.queries import word_tokenizer


def texts_of(items):
    return list(T.chunks(pa.array(items, pa.string()), 64))


def test_words_and_windows():
    items = ["", None, "A b  C", "x", "tab\tend \n", "é—b c", "a" * 200]
    got = []
    for texts in texts_of(items):
        word = T.words(texts, T.SPACED)
        for k in range(len(texts)):
            got.append([T.word_bytes(texts, word, w, 1).decode() for w in range(word.first[k], word.first[k + 1])])
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("A", "a").replace("C", "c")) for t in items]
    whole = next(T.chunks(pa.array(["a b c", "a b", "b c"])))
    first, code = T.windows(T.words(whole, T.SPACED), 2)
    assert first.tolist() == [0, 1, 3, 5] and code[0] == code[2] and code[1] == code[3] and code[0] != code[1]


def test_window_set_marks_every_occurrence():
    known = decontam.WindowSet([("1", "one two three"), ("2", "Three, four"), (None, "nine"), ("3", None)], 3)
    texts = next(T.chunks(pa.array(["zero ONE two three four one two three", "nine", ""])))
    count, hits, items = known.scan(texts)
    assert count.tolist() == [8, 1, 0]
    assert sorted((h["first"], h["length"]) for h in hits[0]) == [(1, 3), (3, 2), (5, 3)]
    assert items == [{"1", "2"}, {None}, set()]


def test_automaton_accepts_what_is_near():
    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(2))
        automaton = toxicity.Automaton(a, 2)
        state = automaton.start()
        for char in b:
            state = automaton.step(state, char)
        assert automaton.distance(state) == (far(a, b) if far(a, b) <= 2 else None)


def test_lexicon_and_context():
    lexicon = toxicity.Lexicon({"idiot", "worthless", "scum"}, {"lowei"})
    assert [lexicon.lookup(w) for w in ("idiot", "idiots", "worthles", "wrothless", "scums", "loweient", "lowe")] == [1, 2, 2, 3, 0, 5, 0]
    rows = toxicity.features(lexicon, pa.array(["You idiot.", 'They said "idiot" there', "", None, "loweia loweib loweic", "a fine day"]))
    assert rows[0, 0] > 0 and rows[0, 4] > 0 and rows[0, 1] == 0
    assert rows[1, 1] > 0 and rows[1, 0] == 0
    assert not rows[2:4].any() and not rows[5].any() and rows[4, 5] > 0 and rows[4, 6] > 0


def test_encoder_gives_the_tokenizers_ids():
    rng = random.Random(2)
    letters = list("abcXYZ 's't'll.,!?<|>éÉßÿŸİΣς́\x1c×÷ﬁ½日\U0001F600'\"()-_") + ["<|endoftext|>", "\n", "  ", " the ", "don't"]
    items = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)] + ["", " \n "]
    encoder, plain = packing.Encoder(word_tokenizer()), Tokenizer.from_file(word_tokenizer())
    got = [ids.tolist() for texts in T.chunks(pa.array(items)) for ids in encoder.encode(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in items]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.choice([10, 50, 4096])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        rows = packing.plan(histogram, capacity)
        bins: dict[int, list[tuple[int, int]]] = {}
        for length, rank, pieces, each, first, offset in rows:
            for k in range(pieces):
                bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert sum(len(b) for b in bins.values()) == len(lengths)
        for inside in bins.values():
            inside.sort()
            ends = [0] + [a + n for a, n in inside]
            assert [a for a, _ in inside] == ends[:-1] and ends[-1] <= capacity
        rooms: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - n)
        assert len(bins) == len(rooms)


def test_every_split_of_an_archive_gives_each_record_once():
    bodies = [b"", b"x" * 5000, bytes(range(256)) * 40, b"\x1f\x8b\x08" * 30, "é".encode() * 10]
    data = b"".join(gzip.compress(warc.record(k, f"http://x/{k}", b, None), mtime=0) for k, b in enumerate(bodies))
    # A gzip magic inside a member that is stored uncompressed must not be taken for a record.
    data += gzip.compress(warc.record(9, None, b"\x1f\x8b\x08\x00 not a member", 3), 0, mtime=0)
    for size in (1, 7, 100, 1000, len(data)):
        rows = [warc.parsed(m) for a in range(0, len(data), size) for m in warc.members(io.BytesIO(data), a, min(a + size, len(data)))]
        assert [r["page_id"] for r in rows] == [0, 1, 2, 3, 4, 9]
        assert [r["payload"] for r in rows[:5]] == bodies
        assert rows[5]["record_type"] == "revisit" and rows[5]["refers_to"] == 3 and rows[5]["payload_bytes"] == 17
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-10]), 0, len(data)))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a></ul></nav><div class="ad">Buy, buy, buy!</div><div id="content"><h1>Head &amp; line</h1>
<p>First, a paragraph <b>of
some</b> length, with commas.<p>Second one, &eacute;&#233; and<br>more.<script>x("</p>")</script></div>
<div class="comments"><p>Reader, says, a, lot, of, things, here, with, commas.</p></div><form><p>Mail, me, now</p></form>
<footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line First, a paragraph of some length, with commas. Second one, éé and more."
    assert main_text(PAGE.replace('<div id="content">', "<article>").replace("</script></div>", "</script></article>")) == main_text(PAGE)
    assert [main_text(t) for t in (None, "", "<p>", "<nav>only</nav>", "bare, text", "a < b")] == ["", "", "", "", "bare, text", "a < b"]
    assert main_text("<article>" + "<p>many, words here</p>" * 5000 + "</article>").count("many") == 5000


def test_network_predicts_from_both_sides():
    rng = np.random.default_rng(5)
    line = lambda: " ".join(f"a{k} b{k}" for k in rng.integers(0, 5, 200))
    column = pa.array([line() for _ in range(60)])
    counts = np.zeros(lm.BUCKETS, np.int64)
    for texts in T.chunks(column):
        counts += np.bincount(lm.buckets(texts)[0], minlength=lm.BUCKETS)
    vocabulary = lm.Vocabulary.of(counts)
    fresh = lm.Network.fresh(np.bincount(vocabulary.class_of, counts, lm.CLASSES))
    score = lambda net, t: sum(lm.log_scores(vocabulary, net, x)[1].sum() for x in T.chunks(t))
    before = score(fresh, column)
    for _ in range(8):
        lm.train(fresh, vocabulary, column, 1, lm.RATE)
    assert score(fresh, column) > 0.8 * before
    empty = next(T.chunks(pa.array(["", None, "a0"])))
    tokens, value = lm.log_scores(vocabulary, fresh, empty)
    assert tokens.tolist() == [0, 0, 1] and value[:2].tolist() == [0, 0]


def test_language_grams_of_long_and_short_texts_agree():
    items = ["", "Hello, World! 123", "été " * 30_000, "日本"]
    rng = np.random.default_rng(6)
    model = langid.Model(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    together = model.log_scores(items)
    for k, item in enumerate(items):
        bucket, _ = langid.grams([item])
        assert np.allclose(together[k], model.weights[bucket].sum(0, dtype=np.float64), rtol=1e-3)
    assert model.predict(["", "123"])[0] == ["und", "und"]


def test_sequential_comparison_keeps_similar_sets():
    rng = np.random.default_rng(8)
    kept = {0.3: 0, 0.8: 0}
    for share in kept:
        for _ in range(60):
            both = int(200 * 2 * share / (1 + share))
            base = rng.integers(1, 1 << 62, 400 - both, dtype=np.uint64)
            one, other = np.unique(base[:200]), np.unique(base[200 - both :])
            _, sign = neardup.signatures([one, other])
            kept[share] += neardup.compare(sign[:1], sign[1:], np.array([200]), np.array([200]))[0] >= 0
    assert kept[0.8] == 60 and kept[0.3] == 0


def test_words_of_a_class_are_told_apart_by_their_context():
    rng = np.random.default_rng(7)
    items = [" ".join(f"left{k} right{k}" for k in rng.integers(0, 400, 300)) for _ in range(100)]
    column = pa.array(items)
    counts = sum(np.bincount(lm.buckets(x)[0], minlength=lm.BUCKETS) for x in T.chunks(column))
    vocabulary = lm.Vocabulary.of(counts)
    net = lm.Network.fresh(np.bincount(vocabulary.class_of, counts, lm.CLASSES))
    score = lambda: sum(lm.log_scores(vocabulary, net, x)[1].sum() for x in T.chunks(column))
    for _ in range(12):
        lm.train(net, vocabulary, column, 1, lm.RATE)
    found = score()
    net.outer[:], net.outer_bias[:] = 0, 0  # classes no longer predicted; what words add within them stays
    used = np.flatnonzero(counts)
    classes = vocabulary.class_of[used]
    shares = np.log(counts[used] / np.bincount(classes, counts[used], lm.CLASSES)[classes]) @ counts[used]
    assert found < 0 and score() + counts.sum() * np.log(lm.CLASSES) > 0.9 * shares


def test_probabilities_of_all_words_add_up_to_one():
    rng = np.random.default_rng(8)
    vocabulary = lm.Vocabulary.of((1e6 / np.arange(1, lm.BUCKETS + 1)).astype(np.int64))
    net = lm.Network(rng.normal(0, 0.3, sum(lm.SIZES)))
    around = np.tile(rng.integers(0, lm.BUCKETS + 1, (1, 2 * lm.SIDE)), (lm.BUCKETS, 1))
    total = np.exp(net.log_probability(vocabulary, around, np.arange(lm.BUCKETS)).astype(float)).sum()
    assert abs(total - 1) < 1e-3


PARTS = [f"Part {k} of the article, with words, commas and a proper end." for k in range(4)]


def paragraphs(tag="p", parts=PARTS):
    return "".join(f"<{tag}>{t}</{tag}>" for t in parts)


def test_wrappers_named_after_furniture_keep_their_article():
    other = '<div class="sidebar"><ul><li><a href=/1>One, two</a></li><li><a href=/2>Three</a></li></ul></div>'
    for before, after in [
        ('<div class="layout has-sidebar"><article>', "</article>" + other + "</div>"),
        ('<div class="post comments-open">', "</div>" + other),
        ('<div id="content-with-sidebar">', other + "</div>"),
        ('<section class="promo"><div>', "</div></section>" + other),
        ('<table class="nav-layout"><tr><td>', "</td></tr></table>"),
    ]:
        assert main_text(f"<body>{before}{paragraphs()}{after}</body>") == " ".join(PARTS), before


def test_comments_go_however_long():
    said = '<div class="comments"><article class="comment"><p>' + "a, lot, of, words, " * 50 + "</p></article></div>"
    for page in (f"<body><div class=post>{paragraphs()}</div>{said}</body>", f"<article>{paragraphs()}{said}</article>"):
        assert main_text(page) == " ".join(PARTS)


def test_articles_of_divisions_and_of_several_articles():
    whole = " ".join(PARTS)
    assert main_text(f"<body>{paragraphs('div')}</body>") == whole
    assert main_text(f"<body><div>{paragraphs('div', [*PARTS, 'Short.'])}</div></body>") == whole + " Short."
    assert main_text(f"<main>{''.join(f'<article><p>{t}</p></article>' for t in PARTS)}</main>") == whole
    links = '<article><a href=/x>Some other article, to be read, here</a></article>'
    assert main_text(f"<div><article>{paragraphs()}</article>{links}</div>") == whole


def test_terms_with_other_letters_are_found_within_their_edits():
    lexicon = toxicity.Lexicon({"schlüsselwort", "worthless"}, set())
    near = ["xchlüsselwort", "schlusselwort", "chlüsselwor", "日worthless日", "worth日日ess", "wörthlëss"]
    far = ["xxxlüsselwort", "日日日worthless"]
    rows = toxicity.features(lexicon, pa.array(near + far))
    assert all(lexicon.lookup(w) for w in near) and not any(lexicon.lookup(w) for w in far)
    assert rows[: len(near)].any(1).all() and not rows[len(near) :].any()


def test_words_of_a_long_text_do_not_depend_on_slices():
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("ab C.,é日 \n"), 3_000))
    texts = next(T.chunks(pa.array([text, "", "tail of another", "x" * 900])))
    for inside in (T.SPACED, T.ALNUM):
        whole = T.words(texts, inside)
        for limit in (1, 7, 500, 3_999):
            cut = T.words(texts, inside, limit=limit)
            assert all(np.array_equal(getattr(whole, f), getattr(cut, f)) for f in ("begin", "end", "hash", "first"))
