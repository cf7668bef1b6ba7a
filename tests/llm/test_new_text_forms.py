"""Filter audit, fill-in-middle and byte-level BPE against brute force and the tokenizer itself."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txrisk.llm import audit, bytebpe, infill
from txrisk.llm.common import table
from txrisk.llm.memo import ABSENT, Memo
from txrisk.llm.queries import byte_tokenizer, queries


# ------------------------------------------------------------- filter audit

def failing(rows):
    """Bits of the failed filters of (doc_id, text) rows, by plain reading of the rules."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bits = int(len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words))
        bits += 4 * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + 8 * any(c in "#$%&*|" for c in text)
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t in rows)
        out.append(bits + 16 * copy)
    return out


def by_application(failed):
    """(order, step) → kept, removed, redundant, unique, and removals summed over all orders, by applying filters."""
    table, totals = {}, Counter()
    for order in permutations(range(5)):
        left = list(failed)
        for step, i in enumerate(order, 1):
            stay = [f for f in left if not f >> i & 1]
            gone = len(left) - len(stay)
            name = "".join("ABCDE"[k] for k in order)
            table[name, step] = (len(stay), gone, sum(f >> i & 1 for f in failed) - gone, failed.count(1 << i))
            totals["ABCDE"[i]] += gone
            left = stay
    return table, totals


def test_audit_equals_applying_the_filters_in_every_order(spark, awkward):
    docs = table(spark, awkward, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"] or "") for r in docs.collect()]
    bits = failing([r[:2] for r in rows])
    got = {(r["part"], r["filter_order"], r["step"]): r for r in queries()["op11_filter_audit"](spark, awkward).collect()}
    for part in {"", "en"}:
        want, totals = by_application([f for f, r in zip(bits, rows) if r[2] == part])
        for (order, step), counts in want.items():
            r = got.pop((part, order, step))
            assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"]) == counts
            assert r["shapley"] == totals[order[step - 1]]
    assert not got


@pytest.mark.parametrize("players", [2, 3, 5])
def test_least_squares_gives_the_mean_marginal_of_any_game(players):
    rng = random.Random(players)
    value = [0] + [rng.randrange(-50, 10**15) for _ in range((1 << players) - 1)]
    want = [Fraction(0)] * players
    orders = list(permutations(range(players)))
    for order in orders:
        before = 0
        for i in order:
            want[i] += Fraction(value[before | 1 << i] - value[before], len(orders))
            before |= 1 << i
    assert audit.shapley(value, players) == want


def test_copies_with_a_hot_text_null_and_repeated_ids(spark):
    rows = [(k if k % 7 else None, "the same text") for k in range(400)] + [(3, "the same text"), (1000, "other"), (1000, "other")]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    got = Counter()
    for r in audit.failures(docs).collect():
        got[r["doc_id"], r["failed"]] += r["n"]
    assert got == Counter(zip((i for i, _ in rows), failing(rows)))


# ----------------------------------------------------------- fill in middle

def filled(doc_id, text):
    """The transformed text, its form and cuts, by plain string work."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in infill.MARKS):
        return text, "plain", None, None, len(units)
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 50:
        return f"<S>{s}<P>{p}<M>{m}", "spm", len(p), len(m), len(units)
    return f"<P>{p}<S>{s}<M>{m}", "psm", len(p), len(m), len(units)


TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "one line\n", "ünï\ncödé 日本語\n🙂\n", "a<P>b\nc", "<S", "<\n<P\n>\nS>\n<M",
    "".join(f"line {k} <P <S <M {'é' * (k % 9)}\n" for k in range(300)), "x" * 5_000 + "\n" + "日" * 5_000, "tail\nwithout end " * 200,
]


@pytest.mark.parametrize("size", [1, 7, 64, infill.FRAME_BYTES])
def test_fill_in_middle_is_that_of_strings_for_any_frame_size(spark, size):
    rows = [(k * 11 if k % 5 else None, t) for k, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n long, doc_id long, text string")
    stored = docs.select("n", "doc_id", infill.framed(F.col("text"), size).alias("of")).select("n", "doc_id", "of.*")
    got = infill.transformed(stored.withColumn("doc_id", F.col("doc_id")))
    got = got.select("*", infill.output_text("output", "form").alias("new"), infill.restored_text("output", "form").alias("old"),
                     infill.digests(F.col("output"), F.col("form")).alias("sha"))
    seen = Counter()
    for r in got.collect():
        seen[r["doc_id"], r["new"], r["form"], r["prefix_chars"], r["middle_chars"], r["units"], r["old"]] += 1
        assert r["sha"]["output"] == hashlib.sha256(r["new"].encode()).hexdigest()
        assert r["sha"]["restored"] == hashlib.sha256(r["old"].encode()).hexdigest()
    want = Counter()
    for i, t in rows:
        new, form, p, m, n = filled(i, t)
        want[i, new, form, p, m, n, t or ""] += 1
    assert seen == want


def test_frames_without_a_cut_are_not_opened():
    raw = b"".join(b"line %d of the text\n" % k for k in range(2_000))
    opened = []

    def decompress(frame):
        opened.append(frame)
        return zstandard.ZstdDecompressor().decompress(frame)

    compress = zstandard.ZstdCompressor().compress
    kept = infill.store_text(raw, compress, 1024)
    text = infill.Stored(kept["frames"], kept["units"], kept["chars"], decompress)
    low, high = text.cut(500), text.cut(1_500)
    assert len(opened) == 2
    middle = text.between(low, high, compress)
    assert len(opened) == 4 and len(kept["frames"]) > 30
    plain = zstandard.ZstdDecompressor()
    assert b"".join(plain.decompress(f) for f in middle) == b"".join(raw.splitlines(True)[500:1_500])


# ------------------------------------------------------------ byte-level BPE

ALPHABET = [
    *"abs tré'çñ,.!  \n\t\r…'“”—日本語1\xa0 🙂٢3<|>x ́　\x1c\x00\x85߿", "<|endoftext|>", "'s", "'re", "'ll", " '", "\U000e0041", "  ", "ẞ",
]


def odd_texts(count):
    rng = random.Random(5)
    some = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(count)]
    ranges = [(0, 0x7F), (0x80, 0x24FF), (0x2500, 0xD7FF), (0xE000, 0x10FFFF), (32, 32), (39, 39), (10, 10)]
    return some + ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(1, 30))) for _ in range(count)]


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_fragments_give_the_ids_of_the_tokenizer(size):
    texts = odd_texts(4_000) + [None, "", "x" * 3_000 + "日" * 3_000 + " " * 500, "word " * 2_000]
    want = [e.ids for e in Tokenizer.from_file(byte_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    column = pa.chunked_array([pa.array(["cut off"] + texts)]).combine_chunks().slice(1)
    got = bytebpe.Encoder(bytebpe.codec(byte_tokenizer())).encode(column, size)
    for text, w, g in zip(texts, want, got):
        assert np.frombuffer(g, "<u4").tolist() == w, text


def test_no_token_spans_a_forced_pair():
    codec = bytebpe.codec(byte_tokenizer())
    for k in range(0, 50_257, 17):
        raw = codec.data[codec.starts[k] : codec.starts[k + 1]]
        assert not codec.forced[raw[:-1], raw[1:]].any()


def test_encoding_and_decoding_whole_tables(spark, sf, awkward):
    library = Tokenizer.from_file(byte_tokenizer())
    for where in (sf, awkward):
        docs = [r for r in table(spark, where, "documents").select("doc_id", "text").collect()]
        want = Counter()
        for r in docs:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        assert Counter(map(tuple, queries()["op13_byte_bpe"](spark, where).collect())) == want


def test_decoding_ids_that_are_no_text(spark):
    library = Tokenizer.from_file(byte_tokenizer())
    rng = random.Random(9)
    rows = [[rng.randrange(50_257) for _ in range(rng.randrange(30))] for _ in range(300)] + [[50_256], []]
    df = spark.createDataFrame([(k, bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(rows)], "k int, ids binary")
    got = {r["k"]: r["text"] for r in df.select("k", bytebpe.decoded(F.col("ids"), byte_tokenizer()).alias("text")).collect()}
    assert got == {k: library.decode(x, skip_special_tokens=False) for k, x in enumerate(rows)}


def test_memo_finds_what_was_added_through_collisions():
    memo = Memo(bits=8)
    rng = np.random.default_rng(3)
    known = {}
    for _ in range(6):
        codes = np.unique(rng.integers(1, 40, 20, dtype=np.uint64) * np.uint64(256) + rng.integers(0, 3, 20, dtype=np.uint64))
        new = codes[memo.find(codes) == ABSENT]
        sizes = rng.integers(0, 4, len(new))
        ids = rng.integers(0, 1 << 30, sizes.sum()).astype(np.uint32)
        memo.add(new, sizes, ids)
        known |= dict(zip(new.tolist(), np.split(ids, np.cumsum(sizes)[:-1])))
        asked = np.array(sorted(known), np.uint64)
        got, total = memo.gather(memo.find(asked))
        for k, code in enumerate(asked.tolist()):
            assert got[total[k] : total[k + 1]].tolist() == known[code].tolist()
    assert (memo.find(np.array([999_999], np.uint64)) == ABSENT).all()
