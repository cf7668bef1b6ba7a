"""Operators on Spark against brute force, held-out rows and round trips."""

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from txrisk.llm import decontam, html, langid, lines, lm, neardup, packing, toxicity, warc
from txrisk.llm.common import table
from txrisk.llm.queries import learnable_labels, queries, word_tokenizer

ASCII_LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))


def shingles(text, n):
    w = words(text)
    return frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_groups(docs, n):
    """doc_id → least id reachable over links of similarity 0.8 or more."""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates_are_those_of_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    want = near_groups(docs, 2)
    for r in queries()["op7_minhash_near_dedup"](spark, sf).collect():
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
        assert r["n_shingles"] == len(shingles(dict(docs)[r["doc_id"]], 2))


def test_blocks_of_a_large_bucket_find_the_links_leaders_miss(spark, monkeypatch):
    """A chain of texts, each close to the next only: tiny blocks and many rounds still give one component."""
    monkeypatch.setattr(neardup, "PIVOTS", 3)
    monkeypatch.setattr(neardup, "OTHERS", 4)
    rows = [(k, " ".join(f"w{j}" for j in range(4 * k, 4 * k + 60)), "x") for k in range(20)]
    rows += [(100 + k, rows[k][1], "y") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, shingle=2).collect()}
    assert found == near_groups([r[:2] for r in rows], 2) and set(found.values()) == {0}
    left = neardup.drop_near_duplicates(df, shingle=2)
    assert left.columns == df.columns and [r["doc_id"] for r in left.collect()] == [0]


def test_packed_ids_are_the_tokenizers_and_bins_are_gapless(spark, sf):
    docs = dict((r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    plain = Tokenizer.from_file(word_tokenizer())
    pieces = packing.pack(table(spark, sf, "documents"), word_tokenizer(), capacity=512, with_ids=True).collect()
    whole = defaultdict(dict)
    bins = defaultdict(list)
    for p in pieces:
        whole[p["doc_id"]][p["start"]] = p["ids"]
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for doc, parts in whole.items():
        ids = [i for at in sorted(parts) for i in parts[at]]
        assert ids == plain.encode(docs[doc] or "", add_special_tokens=False).ids + [1]
    assert set(whole) == set(docs)
    for inside in bins.values():
        ends = [0]
        for offset, length in sorted(inside):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 512
    assert len(bins) <= sum(p["length"] for p in pieces) / 512 * 1.1 + 1


def test_languages_of_held_out_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    got = queries()["op8_language_id"](spark, sf).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity_of_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    got = queries()["op5_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    table_of = Counter((r["toxic"], r["predicted"]) for r in got)
    assert table_of[1, 1] >= 0.8 * (table_of[1, 0] + table_of[1, 1])
    assert table_of[0, 1] <= 0.02 * (table_of[0, 0] + table_of[0, 1])
    assert all(0 <= r["score"] <= 1 for r in got)


def test_scores_are_better_than_word_shares_alone(spark, sf):
    docs = table(spark, sf, "documents")
    vocabulary, net = lm.fit(docs)
    counts = lm.count_words(docs, "text")
    alone = lm.Network.fresh(__import__("numpy").bincount(vocabulary.class_of, counts, lm.CLASSES))
    alone.outer[:] = 0
    column = pa.array([r["text"] for r in docs.select("text").collect()])
    total = lambda n: sum(lm.log_scores(vocabulary, n, x)[1].sum() for x in lm.T.chunks(column))
    assert total(net) > total(alone)
    assert sum(r["n_tokens"] for r in lm.scores(docs).collect()) == counts.sum()


def test_archives_round_trip(spark, awkward):
    pages = table(spark, awkward, "pages")
    got = warc.round_trip(pages, with_payload=True).collect()
    html_of = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    url_of = {r["page_id"]: r["url"] for r in pages.collect()}
    assert len(got) == 9
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html_of[r["page_id"]]
        else:
            assert r["refers_to"] == max(i for i, h in html_of.items() if i is not None and h == html_of[r["page_id"]])
            assert r["payload"] is None
        assert r["payload_bytes"] == len(html_of[r["page_id"]]) and r["url"] == url_of[r["page_id"]]


def test_spans_are_cut_out_of_texts(spark, awkward):
    docs, bench = table(spark, awkward, "documents"), table(spark, awkward, "benchmark").filter("item_id = 1")
    cut = decontam.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.filter("doc_id = 12").first()["text"] == "Some text first. ! And more text after."
    assert decontam.decontaminate(docs, bench).filter("doc_id = 12").count() == 0
    assert decontam.decontaminate(docs, bench).filter("doc_id = 13").count() == 1


def test_a_large_benchmark_is_scanned_in_blocks(spark, sf, monkeypatch):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    once = sorted(map(tuple, decontam.verdicts(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    assert sorted(map(tuple, decontam.verdicts(docs, bench).collect()), key=str) == once
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    monkeypatch.setattr(decontam, "PASS_BLOCKS", 2)
    assert sorted(map(tuple, decontam.verdicts(docs, bench).collect()), key=str) == once


def brute_lines(docs):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(ASCII_LOWER)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    lost = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if lost.get(key(x), i) == i) for i, t in docs}


def test_pipeline_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, learnable_labels(spark, sf))
    bench = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (r["text"] or "").translate(ASCII_LOWER)) for r in table(spark, sf, "benchmark").collect()]
    grams = defaultdict(set)
    for w in filter(None, bench):
        n = min(13, len(w))
        grams[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    def contaminated(text):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(ASCII_LOWER))
        hit = {k + j for n, known in grams.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in known for j in range(n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    now = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    score = model.score(toxicity.features(model.lexicon, pa.array([t for _, t in now])))
    now = [d for d, s in zip(now, score) if s < 0.7]
    now = list(brute_lines(now).items())
    group = near_groups(now, 5)
    now = [d for d in now if group[d[0]] == d[0]]
    now = [d for d in now if not contaminated(d[1])]
    pieces = corpus_pipeline.run(spark, sf).collect()
    plain = Tokenizer.from_file(word_tokenizer())
    want = Counter({i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in now})
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += p["length"]
    assert got == want


def test_pipeline_stages_keep_columns_and_take_empty_tables(spark, awkward, empty):
    docs = table(spark, awkward, "documents")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, awkward).columns == docs.columns
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_html_column(spark):
    df = spark.createDataFrame([("<article><p>a, b</p></article>",), (None,)], "html string")
    assert [r[0] for r in df.select(html.extracted(F.col("html"))).collect()] == ["a, b", ""]


def test_language_model_ignores_rows_without_language(spark):
    df = spark.createDataFrame([("abc", None), (None, "en"), ("abc", "en")], "text string, lang string")
    assert langid.fit(df).languages == ["en"]


def test_keep_bitmaps_name_only_words_with_losses(spark):
    df = spark.createDataFrame([(1, 2, 0), (1, 2, 65), (1, 2, 65), (1, 2, 300)], "doc long, digest long, position int")
    row = lines.keep_bitmaps(df).first()
    assert row["n_dropped"] == 3
    assert [(w["word"], w["bits"] & (2**64 - 1)) for w in row["keep"]] == [(k, 2**64 - 1 - (1 << b)) for k, b in ((0, 0), (1, 1), (4, 44))]


def test_language_model_learns_from_every_token_of_whole_texts(spark):
    rows = [(k, " ".join(f"doc{k}word{j}" for j in range(3))) for k in range(2 * lm.START_DOCS)]
    rows.append((-1, "filler " * 1_000 + " ".join(f"late{j}" for j in range(40))))
    vocabulary, net = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = pa.array([t for _, t in rows])
    at = sorted({b for x in lm.T.chunks(seen) for b in lm.buckets(x)[0].tolist()})
    fresh = lm.Network.fresh(lm.np.ones(lm.CLASSES))
    assert (net.embed[at] != fresh.embed[at]).any(1).all()


def test_rare_terms_are_not_crowded_out(spark):
    common = " ".join(f"{k:x}ca" for k in range(21_000))
    rows = [(k, common + (" zorgblat" if k < 3 else "")) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 5)) for k in range(10)], "doc_id long, toxic int")
    assert "zorgblat" in toxicity.fit(docs, labels).lexicon.words


def test_all_terms_with_enough_support_are_taken(spark):
    docs = spark.range(1_560).selectExpr("id as doc_id", "sha1(string(id div 3)) as text")
    labels = docs.selectExpr("doc_id", "1 as toxic")
    assert len(toxicity.fit(docs, labels).lexicon.words - set(toxicity.GENERAL)) == 520


def test_near_duplicates_with_null_and_repeated_ids(spark):
    base = [f"w{k}" for k in range(101)]
    far = " ".join(f"x{k}" for k in range(60))
    text, shifted = " ".join(base), " ".join(base[2:] + ["y1", "y2"])
    rows = [(1, text, 0), (None, shifted, 1), (5, far, 2), (None, far, 3), (7, far + " z", 4), (7, "a text of its own, unlike all others here", 5), (8, text, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.near_duplicates(df, shingle=2).collect()}
    assert found[None, 100] == 1 and found[8, 100] == 1  # linked through 98 of 102 shingles, and a copy
    left = {r["row"] for r in neardup.drop_near_duplicates(df, shingle=2).collect()}
    assert left == {0, 2, 5}


def test_a_hot_leader_and_blocks_give_few_links(spark, monkeypatch):
    """Texts at a similarity near, but below the threshold: many survive the signatures, none is linked, nothing is written."""
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "PIVOTS", 7)
    monkeypatch.setattr(neardup, "OTHERS", 11)
    common = [f"c{k}" for k in range(150)]
    rows = [(k, " ".join(common + [f"own{k}x{j}" for j in range(22)])) for k in range(30)]
    rows += [(100 + k, " ".join(common + [f"own{k % 3}x{j}" for j in range(22)] + [f"t{k}"])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, shingle=2).collect()}
    assert found == near_groups(rows, 2) and len(set(found.values())) > 20


def test_archives_are_read_by_as_many_tasks_as_ranges(spark, sf, tmp_path):
    manifest = warc.write_archives(table(spark, sf, "pages"), f"{tmp_path}/warc")
    total = manifest.agg(F.sum("bytes")).first()[0]
    read = warc.read_archives(spark, manifest, split_bytes=total // 9)
    tasks = read.withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert tasks >= 7 and read.count() == table(spark, sf, "pages").count()


def test_weights_are_averaged_alike_in_one_step_and_two(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").repartition(6, "doc_id")
    _, two = lm.fit(docs)
    monkeypatch.setattr(lm, "AVERAGED", 1)
    _, one = lm.fit(docs)
    assert abs(one.flat - two.flat).max() < 1e-5
