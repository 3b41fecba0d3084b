"""Training-data operators against brute force, round trips and hand-made cases; edge cases are in test_cases.py."""

import hashlib
import random
import zlib
from collections import Counter
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import byte_bpe, embedding_dedup, language_id, license_scan, media, minhash, mixing, quality, toxicity, warc
from quadrille.llm.common import BATCHES, PRUNE, TEXT_ROWS, setting, spaced_words, stored
from quadrille.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, id string, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def rows_of(texts, lang="en", source="s"):
    return [(i, t, lang, source, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(12)]
    near = [" ".join(w if rng.random() > 0.02 else "changed" for w in base[k % 4].split()) for k in range(24)]
    return [None, "", "one", "one two", *base, *base[:3], *near, "long " + " ".join(rng.choice(WORDS) + str(i) for i in range(5000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[129] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_equals_brute_force(spark, docs, texts):
    sets = {}
    for i, t in enumerate(texts):
        w = spaced_words(t)
        sets[i] = frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in minhash.near_duplicates(docs, words=3, percent=85).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_large_buckets_keep_their_links(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    near = [" ".join(w if rng.random() > 0.03 else f"c{rng.random()}" for w in base) for _ in range(60)]
    df = spark.createDataFrame(rows_of(near), SCHEMA)
    monkeypatch.setattr(minhash, "SMALL", 2)
    blocks = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=3, percent=80).collect()}
    monkeypatch.setattr(minhash, "SMALL", 10_000)
    listed = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=3, percent=80).collect()}
    assert blocks == listed


def test_pairs_just_above_the_threshold_are_linked(spark):
    bands = minhash.bands_for(80)
    assert minhash.bands_for(85) == (12, 5, 12) and bands.missed(0.8) < 1e-3
    assert all(minhash.bands_for(p).missed(p / 100) <= minhash.MISSED for p in range(40, 100))
    rng = random.Random(7)
    texts = []
    for k in range(3000):  # 96 five-word shingles a text; two changed words leave 86 of 106 in common, 0.811
        w = [f"{k}w{rng.random()}" for _ in range(100)]
        texts += [" ".join(w), " ".join("changed" if i in (30, 60) else x for i, x in enumerate(w))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert all(got[2 * k] == 2 * k for k in range(3000))
    assert sum(got[2 * k + 1] != 2 * k for k in range(3000)) <= 8


def test_bpe_equals_the_library(spark, docs, texts):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.codec(path, public.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice("aaabbc the\n\t!?'sé漢🙂ß1 23") for _ in range(rng.randrange(60)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == library.encode_ordinary(s)
        assert own.decode(own.encode(s)) == s.encode()
    for r in byte_bpe.tokenize(docs, path, public.PATTERN).collect():
        t = texts[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(1000)]
    h = byte_bpe.PerfectHash.build(keys)
    assert sorted(map(h.slot, keys)) == list(range(1000))


def test_language(spark):
    rng = random.Random(2)
    syllables = {"aa": ["the", "ing", "ough", "sh"], "bb": ["ung", "keit", "sch", "eit"], "cc": ["tion", "eau", "eux", "que"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(60))
    rows = [(i, make(lang), lang, "s", "x", "y") for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa", "s", "x", "y"), (901, "", None, "s", "x", "y"), (902, "12 ³ !!", None, "s", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    content = language_id.learn(df, df["doc_id"] < 90)
    got = {r.doc_id: r for r in language_id.identify(df, content).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[90:180])
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert language_id.filter_identified(df, content).columns == df.columns
    assert language_id.identify(df, {}).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark):
    s = toxicity.Scorer({"vequx": 0.95, "lowe*": 0.95})
    assert s.score(None) == s.score("") == 0 and s.score("a calm day, no harm done") == 0
    assert s.score("you are a stupid idiot") > 0.9
    assert s.score("an idiot") >= toxicity.THRESHOLD > s.score("he is not an idiot")
    assert s.score("she said he was an idiot") < s.score("an idiot")
    assert s.score("vequx") < toxicity.THRESHOLD <= s.score("vequx. loweiab")
    assert s.score("x " * 50_000 + "worthless scum") > 0.9
    docs = spark.createDataFrame(rows_of(["fine day"] * 20 + ["fine vexo vexo"] * 20), SCHEMA)
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "doc_id long, toxic int")
    assert "vexo" in toxicity.learn(docs, labels, labels["doc_id"] % 4 != 0)


def test_license_scan_by_hand(spark):
    texts = ["Released under the MIT License.", "mit license mit license", None, "", "Licensed under the Apache-License, version 2", "nothing here", "MIT\nlicense"]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].labels) == (1, 3, "mit")
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (2, 0, 2)
    assert (got[2].n_words, got[2].labels, got[2].score) == (0, "", 0.0)
    assert got[4].base_labels == "apache" and got[5].score == 0.0 and got[6].n_base == 1


def test_license_windows_see_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License"
    texts = [bsd, "Licensed under CC\nBY-NC 4.0", gpl, "Released under the BSD license", "Licensed under CC BY 4.0", None, "", "mit " * 500, "x " * 900 + bsd]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [got[i].labels for i in range(9)] == ["bsd", "cc-by-nc", "gpl", "", "", "", "", "", "bsd"]
    assert got[0].score == got[1].score == got[8].score == 1.0 and got[3].score == 0.0
    assert license_scan.scan(df.limit(0)).count() == 0


def test_license_windows_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from quadrille.llm.license_scan_query import ORACLES

    rng = random.Random(11)
    words = [w for text, _ in license_scan.TEMPLATES for w in text.split()]
    texts = [None, "", *(" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60))]
    for text, _ in license_scan.TEMPLATES:
        for _ in range(25):
            w = [x for x in text.split() if rng.random() > 0.12]
            for _ in range(rng.randrange(5)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["other", *words]))
            texts.append("a b " + "".join(x + rng.choice(" \n") for x in w) + rng.choice(words))
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = sorted(con.execute(f"select {', '.join(names)} from ({ORACLES['op2_license_scan']})").fetchall())
    got = license_scan.scan(spark.read.parquet(str(tmp_path / "documents.parquet"))).select(names).collect()
    assert sorted(map(tuple, got)) == want and len({r.labels for r in got}) > 4


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), None, [None, "a", "b", "c", "d"][i % 5], "x", "y") for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    order = ["a", "b", "c", "d", None]
    weight = dict(zip(order, [5, 2, 1, 5, 2], strict=True))
    goal, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            goal |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            goal[s] = 2.0 * size[s]
            left -= goal[s]
        open_ -= full
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 40 for s in order)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_media(spark, docs, texts):
    got = media.media_columns(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32, r.height) == (len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) // 64)
    places = media.resolve(media.store(docs))
    assert {(r.width, r.depth) for r in media.metadata(places).collect()} == {(64, 8)}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    x = np.concatenate([centre[i] + s * rng.normal(size=(n, 16)) for i, (n, s) in enumerate([(60, 0.05), (60, 0.2), (30, 0.35), (5, 0.01), (1, 0), (1, 0)])])
    rows = [(i, [float(v) for v in np.float32(r)], i % 2) for i, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.array([label[n].min() for n in near])
    for r in embedding_dedup.near_duplicates(df).collect():
        if r.vec_id is not None and r.vec_id < 900:
            assert (r.n_links, r.component_id) == (near[r.vec_id].sum() - 1, label[r.vec_id])
        else:
            assert r.n_links == 0 and r.kept


def test_warc(spark):
    big = "é" * 100_000
    htmls = [big, "short", "short", None, big, "x" * 100, "x" * 100, ""]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", h, "clash") for i, h in enumerate(htmls)], "page_id long, url string, html string, digest string")
    archives = warc.write(warc.chunked(warc.planned(pages)))
    got = {r.page_id: r for r in warc.read(archives).collect()}
    for i, h in enumerate(htmls):
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {4: 0, 6: 5}
    chunks = warc.read_chunks(archives).where("length(data) > 0").groupBy("record_id").count().collect()
    assert max(c["count"] for c in chunks) >= 4


def test_quality_learns(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "en", "good.org" if i % 3 else "bad.org", "x", "y") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, None, None, "x", "y")], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.learn(docs, labels, labels["doc_id"] < 200)).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 > 0) for i in range(200, 300)) >= 97 and 0 <= got[900] <= 1


def test_pipeline_stages(spark, texts, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows_of([*texts, "you stupid worthless scum " * 5]), SCHEMA).drop("id", "key").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 0), (5, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = Counter(r.doc_id for r in docs.collect())
    assert len(texts) in seen["language"] and len(texts) not in seen["toxicity"]
    assert set(range(4, 16)) <= set(seen["near duplicates"]) and not set(range(16, 19)) & set(seen["near duplicates"])
    assert seen["mixing"] == seen["encoding"] and max(seen["mixing"].values()) <= 2


def linked_by_force(texts, words, percent):
    """(n_shingles, component) of every text by comparing all pairs."""
    sets = []
    for t in texts:
        w = spaced_words(t)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small", [8, 0, 10_000])
def test_minhash_large_groups_on_either_side_of_the_switch(spark, monkeypatch, small):
    """Groups of over 60 copies whose pairs lie around the threshold; lists, blocks and both together."""
    monkeypatch.setattr(minhash, "SMALL", small)
    rng = random.Random(17)
    made = []
    for size, change in ((70, 0.004), (70, 0.012), (30, 0.02), (12, 0.03)):
        base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(150)]
        made += [" ".join(w if rng.random() > change else rng.choice(WORDS) for w in base) for _ in range(size)]
    want = linked_by_force(made, 3, 85)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows_of(made), SCHEMA), words=3, percent=85).collect()}
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(made))] == want


def test_minhash_repeated_ids_nulls_and_empty(spark):
    base = [" ".join(f"{w}{k}" for w in WORDS) for k in range(4)]
    rows = [(1, base[0]), (1, base[0]), (2, base[0]), (2, base[1]), (5, base[1]), (None, base[0]), (7, None), (7, ""), (8, base[2]), (8, base[3]), (9, base[3])]
    df = spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)
    n = len(WORDS) - 4
    want = [(1, n, 1, True), (1, n, 1, True), (2, n, 1, False), (2, n, 2, True), (5, n, 2, False), (None, n, None, True), (7, 0, 7, True), (7, 0, 7, True), (8, n, 8, True), (8, n, 8, True), (9, n, 8, False)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_bands_are_thinned_before_their_shuffle(spark, docs, monkeypatch):
    """Where the counts are joined by a shuffle, a Bloom filter drops the bands that no other set has before it."""
    plans = {}

    def seen(df, tag, prune=False):
        with ExitStack() as held:
            for name, value in (PRUNE if prune else {}).items():
                held.enter_context(setting(spark, name, value))
            plans.setdefault(tag, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, tag, prune)

    monkeypatch.setattr(minhash, "stored", seen)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        got = {tuple(r) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert "might_contain" in plans["bands"][1] and "bands" not in plans["rows"][0].split("\n")[0]
    monkeypatch.undo()
    assert got == {tuple(r) for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}


def test_pipeline_hands_texts_over_in_small_batches(spark, texts, tmp_path):
    import corpus_pipeline

    def largest() -> int:
        lengths = spark.range(0, 3000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        return max(r.n for r in lengths.collect())

    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for name in BATCHES:
        spark.conf.unset(name)
    try:
        assert largest() > TEXT_ROWS
        assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == len(texts)
        assert largest() <= TEXT_ROWS
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # a session's own setting stays
        corpus_pipeline.encode(spark, docs, str(tmp_path))
        assert largest() == 2000
    finally:
        for name in BATCHES:
            spark.conf.unset(name)
