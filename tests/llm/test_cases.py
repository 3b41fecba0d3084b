"""Edge cases that every training-data operator must handle: empty tables, nulls in any column, repeated
rows, ties, very long texts and columns whose names clash with internal ones."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import byte_bpe, embedding_dedup, language_id, license_scan, media, mixing, quality, toxicity, warc
from quadrille.llm.common import spread_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, label int, digest string, row string, copies int, mix_copies int, words int"
LONG = "alpha beta gamma " * 20_000


def table(spark, rows):
    """Documents of (doc_id, text, lang, source) with columns of clashing names."""
    return spark.createDataFrame([(i, t, lang, source, 0, "x", "y", 1, "d", "r", 7, 7, 7) for i, t, lang, source in rows], SCHEMA)


HARD = [(1, "you are an idiot", "en", "a"), (1, "you are an idiot", "en", "a"), (2, None, None, None), (None, "no id and no source", "en", None), (3, "", "en", "a"), (4, " \n\t ", None, "b"), (5, LONG, "en", "b"), (6, "12 34 !!", None, "a"), (6, "another text of that id", "de", "b")]


@pytest.fixture(scope="module")
def hard(spark):
    return table(spark, HARD)


@pytest.fixture(scope="module")
def none(spark, hard):
    return hard.limit(0)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


EVERY = sorted((r[0] for r in HARD), key=str)


# toxicity
def by_force(text: str, learned: dict) -> float:
    """The grammar without machines: every hit looks for its triggers word by word."""
    X, rest = toxicity, 1.0
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)

        def near(i, among, reach, step=-1, words=words):
            return any(0 <= j < len(words) and words[j] in among for j in range(i + step, i + step * (reach + 1), step))

        mass = 1.0
        for i, w in enumerate(words):
            aimed = near(i, X.TARGETS, 3, 1) or near(i, X.TARGETS, 4)
            if w in X.BASE_INSULTS:
                factor = X.AIMED if aimed else X.COPULAR if near(i, X.COPULAS, 3) else X.ISOLATED
                weight = X.BASE_WEIGHT
            elif w in X.BASE_THREATS:
                behind = near(i, X.TARGETS, 3, 1)
                factor = (X.AIMED if near(i, X.INTENTS, 4) else X.AIMED * X.UNINTENDED) if behind else X.AIMLESS
                weight = X.BASE_WEIGHT
            elif w in learned:
                weight, factor = X.LEARNED_PART * learned[w][0], X.TARGETED if near(i, X.TARGETS, 4) else 1.0
            else:
                continue
            factor *= (X.NEGATED if near(i, X.NEGATIONS, 3) else 1.0) * (X.REPORTED if near(i, X.REPORTS, 6) else 1.0)
            mass *= 1 - X.HIT_MASS * min(1.0, weight * factor)
        rest *= mass
    return 1 - rest


def test_toxicity_grammar_on_sentences():
    score = toxicity.Scorer({}).score
    for harmless in ("an idiot", "The clown made the children laugh at the circus.", "The idiot is a novel by Dostoevsky.", "please kill the process and restart", "burn the disc, shoot the film, beat the eggs, hang the coat, attack the problem, destroy the cache", "I will not kill you", "you are not an idiot", "he said you are an idiot"):
        assert score(harmless) < toxicity.THRESHOLD, harmless
    for toxic in ("I will kill you", "you are an idiot", "you idiot", "He is such a moron", "We will hurt them", "idiot, all of you"):
        assert score(toxic) >= toxicity.THRESHOLD, toxic
    assert score("I will kill you") > score("please kill the process and restart")


def test_toxicity_machines_equal_brute_force():
    rng = random.Random(3)
    learned = {"grob": (0.9, False), "feind": (1.0, False)}
    words = [*toxicity.BASE_INSULTS[:4], *toxicity.BASE_THREATS[:4], *toxicity.TARGETS[:4], *toxicity.NEGATIONS[:2], *toxicity.REPORTS[:2], *toxicity.COPULAS[:2], *toxicity.INTENTS[:2], *learned, *(f"word{c}" for c in "abcdefgh")]
    scorer = toxicity.Scorer(learned)
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(rng.randrange(1, 25)))
        assert scorer.score(text) == pytest.approx(by_force(text, learned), abs=1e-12), text


def test_toxicity_cases(spark, hard, none):
    got = toxicity.score_texts(hard, {}).collect()
    assert ids(got) == EVERY and all(0 <= r.score <= 1 for r in got) and sum(r.score >= 0.7 for r in got) == 2
    kept = toxicity.filter_toxic(hard, {})
    assert kept.columns == hard.columns and kept.count() == len(HARD) - 2
    assert toxicity.score_texts(none, {}).count() == 0 and toxicity.filter_toxic(none, {}).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(hard, empty, F.lit(True)) == {} and toxicity.learn(none, empty, F.lit(True)) == {}
    threat = table(spark, [(i, "I will smash you . hello grob", "en", "s") if i < 6 else (i, "hello you will", "en", "s") for i in range(20)])
    labels = spark.createDataFrame([*((i, int(i < 6)) for i in range(20)), (0, 0), (3, None)], "doc_id long, toxic int")
    learned = toxicity.learn(threat, labels, F.lit(True))
    assert learned["smash"][1] and not learned["grob"][1] and "hello" not in learned and "you" not in learned


# licenses
def test_license_cases(spark, hard, none):
    got = license_scan.scan(hard).collect()
    assert ids(got) == EVERY and {r.labels for r in got} == {""}
    assert license_scan.scan(none).count() == 0
    two = [("some words of a notice", "one"), ("words some notice of a", "two")]  # the same tokens: a tie
    rows = table(spark, [(1, "Some words\nof a notice", None, None), (2, LONG + " some words of a notice", None, None), (3, "some words", None, None)])
    as_table = spark.createDataFrame(two, "text string, label string")
    for templates in (two, as_table):
        assert {r.doc_id: r.labels for r in license_scan.scan(rows, templates=templates).collect()} == {1: "one,two", 2: "one,two", 3: ""}
    assert {r.labels for r in license_scan.scan(rows, templates=[]).collect()} == {""}


def test_license_batches_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    words = [w for text, _ in license_scan.TEMPLATES for w in text.split()]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)] + [f"x {t}\ny" for t, _ in license_scan.TEMPLATES]
    df = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    whole = sorted(license_scan.scan(df).collect())
    monkeypatch.setattr(license_scan, "BATCH_TOKENS", 12)
    assert len(list(license_scan.batches(license_scan.TEMPLATES))) > 3
    assert sorted(license_scan.scan(df).collect()) == whole


# languages
def test_language_cases(spark, hard, none):
    words = {"en": "the house and the garden of that man", "de": "das haus und der garten von dem mann", "fr": "la maison et le jardin de cet homme"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(30)), x, "s") for i, x in enumerate(["en", "de", "fr"] * 40)]
    content = language_id.learn(table(spark, rows), F.lit(True))
    got = {}
    for r in language_id.identify(hard.unionByName(table(spark, [(900, "der garten und das haus " * 5000, None, None), (901, "7 der 8 garten und haus", None, None)])), content).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[900][0].lang_pred == got[901][0].lang_pred == "de"
    assert {r.lang_pred for r in (*got[2], *got[3], *got[4])} == {"und"} and got[1][0] == got[1][1]
    assert language_id.learn(none, F.lit(True)) == {} and language_id.identify(none, content).count() == 0
    assert {r.lang_pred for r in language_id.identify(hard, {}).collect()} == {"und"}
    # languages without words of their own still answer for texts with letters, and ties go to the first
    tie = language_id.Classifier({"aa": b"", "bb": b""})
    assert tie.classify("some letters") == ("aa", 0.0, True) and tie.classify("12 !") == ("und", 0.0, True)
    assert language_id.filter_identified(hard, content).columns == hard.columns


# media
def test_media_cases(hard, none):
    got = media.media_columns(hard).collect()
    assert ids(got) == EVERY and media.media_columns(none).count() == 0
    for r in got:
        image = [media.encode(media.padded(t)[0]) for i, t, *_ in HARD if i == r.doc_id]
        shas = {hashlib.sha256(x).hexdigest(): (len(x), media.feature(media.decode(x))) for x in image}
        assert shas[r.media_sha256] == (r.media_bytes, r.feature) and r.payload_bytes % 64 == 0 and r.payload_sha256 == r.digest
    assert len({(r.media_sha256, r.shard, r.offset) for r in got if r.doc_id in (2, 3)}) == 1


def test_spread_join_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr("quadrille.llm.common.HOT_LEAST", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}", None if i % 11 == 0 else i) for i in range(300)], "id long, k string, x long")
    values = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("total")).where("k <> 'k3'")
    got = spread_join(rows, values, ["k"], ["id"], 300).select("id", "k", "x", "total", "met")
    want = rows.join(values.drop("n"), "k", "left").select("id", "k", "x", "total", (F.col("k") != "k3").alias("met"))
    assert sorted(got.collect()) == sorted(want.collect())


# mixing
def test_mixing_cases(spark, hard, none):
    got = mixing.mix(hard).collect()
    assert ids(got) == EVERY and all(0 <= r.taken <= 2 * r.size for r in got) and mixing.mix(none).count() == 0
    assert len({(r.copies, r.taken) for r in got if r.doc_id == 1}) == 1
    many = table(spark, [(i, "a b c", None, f"s{i:05d}") for i in range(500)])
    targets = {r.source: r.target for r in mixing.mix(many).collect()}
    # all sizes are equal: caps of 6 words by weight, as by hand
    total, weight, left, open_ = 500 * 3 * 1.5, [(5, 2, 1)[i % 3] for i in range(500)], 500 * 3 * 1.5, set(range(500))
    goal = {}
    while open_:
        level = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if weight[i] * level > 6}
        goal |= {i: 6.0 if i in full else weight[i] * level for i in (full or open_)}
        left -= 6.0 * len(full)
        open_ = open_ - full if full else set()
    assert [targets[f"s{i:05d}"] for i in range(500)] == pytest.approx([goal[i] for i in range(500)]) and sum(goal.values()) == pytest.approx(total)


# embeddings
def test_embedding_cases(spark):
    rng = np.random.default_rng(1)
    wide = rng.normal(size=(3, 3072))
    wide = [wide[0], wide[0] + 0.01 * rng.normal(size=3072), wide[2]]
    a = [1.0, 0.0, 0.0, 0.0]
    at = [0.95, float(np.sqrt(1 - 0.95**2)), 0.0, 0.0]
    below = [0.9499, float(np.sqrt(1 - 0.9499**2)), 0.0, 0.0]
    rows = [(1, a), (2, at), (3, below), (1, a), (4, [2.0, 0.0, 0.0, 0.0]), (10, wide[0].tolist()), (11, wide[1].tolist()), (12, wide[2].tolist()), (20, None), (21, []), (22, [0.0, 0.0]), (23, [1.0, None]), (None, a), (24, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, cap string")
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    exact = np.dot(np.array(at) / np.linalg.norm(at), a) >= 0.95
    linked = 3 + exact
    want = [(1, linked - 1, 1, True)] * 2 + [(4, linked - 1, 1, False), (2, 3 * exact + 1, 1, False), (3, 1, 1, False), (10, 1, 10, True), (11, 1, 10, False), (12, 0, 12, True)]
    want += [(i, 0, i, True) for i in (20, 21, 22, 23, 24)] + [(None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_a_beam_widens_until_its_audit_passes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embedding_dedup.Hnsw.build(x)
    wide = 0.15
    beam = embedding_dedup.audited_beam(graph, x, wide, 4)
    assert beam > 4
    q = x[:200]
    a, b = embedding_dedup.asked_pairs(graph, x, q, np.full(len(q), wide), 4)
    truth = {(i, j) for i, j in zip(*np.nonzero(q @ x.T >= wide), strict=True)}
    assert len(truth & set(zip(a.tolist(), b.tolist(), strict=True))) >= 0.98 * len(truth)


# byte-level BPE
def test_bpe_cases(hard, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = byte_bpe.tokenize(hard, path, public_tokenizers.PATTERN).collect()
    assert ids(got) == EVERY and byte_bpe.tokenize(none, path, public_tokenizers.PATTERN).count() == 0
    assert {r.decoded_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}


# quality
def test_quality_cases(spark, hard, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(hard, quality.learn(hard, empty, F.lit(True))).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1), (5, None)], "doc_id long, quality int")
    assert len({r.score for r in quality.score(hard, quality.learn(hard, one, F.lit(True))).collect()}) == 1
    model = quality.learn(hard, one, F.lit(True))
    assert quality.score(none, model).count() == 0 and quality.score(none, quality.learn(none, empty, F.lit(True))).count() == 0


def test_surest_rows_equal_a_sort_of_all(spark):
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(700, n)).astype(np.float16) for n in (quality.CONTENT_SIZE, quality.META_SIZE)]
    pool = spark.createDataFrame([(i, bytearray(a.tobytes()), bytearray(b.tobytes())) for i, (a, b) in enumerate(zip(*x, strict=True))], "key long, content binary, meta binary").repartition(5)
    y = (x[0][:, 0] + x[1][:, 0] > 0).astype(int)
    views = [quality.Linear.fit(v.astype(float), y) for v in x]
    got = quality.surest_rows(pool, views, {1: 5, 0: 7}, {3, 4})
    for me in (0, 1):
        odds = views[me].odds(x[me].astype(float))
        for label in (0, 1):
            sure = odds if label else -odds
            order = [int(i) for i in np.argsort(-sure, kind="stable") if i not in (3, 4)][:24]
            assert [k for k, _ in got[me, label]] == order


# WARC
def test_warc_cases(spark):
    big = "z" * 200_000
    rows = [(5, big), (3, big), (3, big), (None, big), (7, None), (7, ""), (9, "w" * 100), (None, "w" * 100), (None, "v" * 100), (None, "v" * 100), (8, "u" * 99), (8, "u" * 99)]
    pages = spark.createDataFrame([(i, None if k % 2 else f"http://h/{k}", h, "c", "d") for k, (i, h) in enumerate(rows)], "page_id long, url string, html string, digest string, payload string")
    got = warc.read(warc.write(warc.chunked(warc.planned(pages)))).collect()
    by = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str)
    want = [(5, 200_000, "revisit", 3), (3, 200_000, "response", None), (3, 200_000, "response", None), (None, 200_000, "revisit", 3), (7, 0, "response", None), (7, 0, "response", None), (9, 100, "response", None), (None, 100, "revisit", 9), (None, 100, "response", None), (None, 100, "response", None), (8, 99, "response", None), (8, 99, "response", None)]
    assert by == sorted(want, key=str)
    assert warc.read(warc.write(warc.chunked(warc.planned(pages.limit(0))))).count() == 0


# the pipeline
def test_pipeline_stages_on_hard_and_empty_tables(spark, hard, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0
        if name != "encoding":
            assert out.columns == hard.columns
    twice = hard.unionByName(table(spark, [(70, "one two three four five six seven", "en", "a"), (71, "one two three four five six seven", "en", "a"), (71, "one two three four five six seven", "en", "a"), (71, "a text that only this row of the id has", "en", "a")]))
    left = corpus_pipeline.drop_near_duplicates(spark, twice, str(tmp_path))
    texts = [r.text for r in left.collect()]
    assert left.columns == hard.columns
    assert sorted(t for t in texts if t and t.strip() and t != LONG) == sorted({t for _, t, *_ in HARD if t and t.strip() and t != LONG} | {"one two three four five six seven", "a text that only this row of the id has"})
    assert sum(not (t or "").strip() for t in texts) == 3
    mixed = corpus_pipeline.mix_sources(spark, hard, str(tmp_path))
    assert mixed.columns == hard.columns and {r.doc_id for r in mixed.collect()} <= {r[0] for r in HARD}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage worked out row by row in plain Python; the mix by its constraints and its own decisions."""
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    import corpus_pipeline
    from quadrille.llm.common import crc_mod

    from .test_llm import linked_by_force

    rng = random.Random(23)
    vocabulary = {"en": [f"the{c}ing" for c in "abcdefghijk"], "de": [f"der{c}ung" for c in "abcdefghijk"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        text = " ".join(rng.choice(vocabulary[lang]) + rng.choice("xyz") for _ in range(25))
        if i % 9 == 4:
            text += " you are an idiot"
        if i % 10 == 7:
            text = rows[-2][1] + (" end" if i % 20 == 7 else "")
        rows.append((i, "..." if i == 33 else text, None if i % 13 == 0 else lang, f"s{i % 4}" if i % 5 else None))
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 == 4)) for i in range(0, 60, 2)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = language_id.Classifier(language_id.learn(docs, crc_mod(docs["doc_id"], 4) != 2))
    left = [r for r in rows if not model.classify(r[1])[2]]
    assert 33 not in [r[0] for r in left]
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    spoken = docs.where(F.col("doc_id").isin([r[0] for r in left]))
    learned = toxicity.learn(spoken, labels, crc_mod(labels["doc_id"], 3) != 1)
    words = {t: x for t, x in learned.items() if not t.endswith("*")}
    assert len(words) == len(learned)  # the plain version below knows whole words
    left = [r for r in left if by_force(r[1], words) < toxicity.THRESHOLD]
    groups = linked_by_force([r[1] for r in left], 5, 80)
    left = [r for i, r in enumerate(left) if groups[i][1] == i]
    kept = docs.where(F.col("doc_id").isin([r[0] for r in left]))
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect()}
    targets = {r.source: r.target for r in mixing.mix(kept).collect()}
    for source, target in targets.items():
        own = [r for r in left if r[3] == source]
        assert abs(sum(copies[r[0]] * len(r[1].split()) for r in own) - target) <= max(len(r[1].split()) for r in own)
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    want = sorted((r[0], hashlib.sha256(np.array(coder.encode_ordinary(r[1]), dtype="<u4").tobytes()).hexdigest()) for r in left for _ in range(copies[r[0]]))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == want and 20 < len({i for i, _ in want}) < 60


def test_language_sizes_are_those_of_plain_compression():
    import zstandard

    rng = random.Random(4)
    content = {lang: " ".join(rng.choice("abcdefgh") * 3 + lang for _ in range(300)).encode() for lang in ("one", "two")}
    model = language_id.Classifier(content)
    for n in (1, 20, 3000):
        text = " ".join(rng.choice("abcdefgh") * 3 + "two" for _ in range(n))
        data = language_id.letters(text)
        sizes = []
        for lang in content:
            held = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            plan = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, source_size=language_id.BLOCK, dict_size=len(content[lang]), min_match=language_id.SHORTEST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(zstandard.ZstdCompressor(dict_data=held, compression_params=plan).compress(data[i : i + language_id.BLOCK])) for i in range(0, len(data), language_id.BLOCK)))
        assert model.classify(text)[0] == ["one", "two"][sizes.index(min(sizes))]  # a word alone is a tie
        assert n == 1 or sizes[1] < sizes[0]
