"""Spaces, entity resolution, documents and rollups."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quadrille import catalog
from quadrille.catalog import kg_catalog
from quadrille.engine import Engine
from quadrille.functions import fuzzy
from quadrille.operators import derived as D
from quadrille.operators.derived import EDGE_DEST, EDGE_SOURCE, KG, materialised_links, pair_stats
from quadrille.operators.kgquery import FRAME_TYPE, entity_graph, shared_frames
from quadrille.operators.registry import by_identifier, canonical, hybrid, related
from quadrille.operators.spaces import SLOT_PROPERTIES, Job, Space
from quadrille.sources.documents import pieces, segments, to_markdown
from quadrille.streaming.rollup import rollup, stream_to_table


def test_space_life(spark, tmp_path):
    s = Space(spark, str(tmp_path), "one").create()
    s.update("INSERT DATA { <u:a> <u:p> 1 . GRAPH <u:g> { <u:b> <u:p> 2 } }")
    s.export(str(tmp_path / "out"))
    other = Space(spark, str(tmp_path), "two").create()
    assert Job("import", "two", str(tmp_path / "out")).run(other, kind="nquads").status == "completed"
    assert other.quads().count() == 2 and other.graph_counts().count() == 2
    assert Job("import", "two", str(tmp_path / "none")).run(other, kind="nquads").status == "failed"
    assert {"one", "two"} <= set(Space.list_spaces(spark, str(tmp_path)))
    other.drop()
    assert not other.exists()


def test_pair_statistics_keep_pairs_of_any_table(spark, tmp_path):
    spark.range(300).selectExpr("id as c_custkey", "id % 2 as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = catalog.collected("QUERIES")["pair_statistics_whole"](spark, str(tmp_path)).collect()
    assert sorted((r.object, r.quads) for r in got) == [("Iurn:nation:0", 150), ("Iurn:nation:1", 150)]
    quads = spark.createDataFrame([("s1", "p", "a"), ("s2", "p", "a"), ("s3", "p", "a"), ("s4", "p", "b")], "s string, p string, o string")
    assert [(r.object, r.quads) for r in pair_stats(quads, 2).collect()] == [("b", 1)] and pair_stats(quads, 3).count() == 2


def test_optional_orders_of_all_customers(spark, tmp_path):
    spark.range(200).selectExpr("id as c_custkey", "concat('c', id) as c_name", "0L as c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(100).selectExpr("id as o_orderkey", "id * 2 as o_custkey", "if(id % 2 = 0, 200000D, 1000D) as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.collected("QUERIES")["optional_orders_whole"](spark, str(tmp_path)).collect()
    assert len(got) == 200 and {(r.name, r.o) for r in got if r.o} == {(f"c{2 * k}", f"urn:orders:{k}") for k in range(0, 100, 2)}


def test_frames_graphs_and_links(spark, tmp_path):
    s = Space(spark, str(tmp_path), "kg").create()
    edge = lambda e, a, b: f"<{e}> <{EDGE_SOURCE}> <{a}> ; <{EDGE_DEST}> <{b}> ."
    s.update(f"""INSERT DATA {{ {edge("u:1", "u:a", "u:f")} {edge("u:2", "u:b", "u:f")} {edge("u:3", "u:b", "u:g")}
      <u:f> <{FRAME_TYPE}> <u:meeting> . <u:g> <{FRAME_TYPE}> <u:other> . <u:a> a <u:A> . <u:f> a <u:F> .
      <u:f> <{KG}hasKGGraphURI> <u:a> . <u:g> <{KG}hasKGGraphURI> <u:b> }}""")
    assert [tuple(r) for r in shared_frames(Engine(s.store()), "u:meeting").collect()] == [("u:a", "u:f", "u:b")]
    of_a = entity_graph(s.quads(), spark.createDataFrame([("u:a",)], "entity string"))
    assert {r.s for r in of_a.collect()} == {"Iu:f"} and of_a.count() == 3
    links = materialised_links(s.quads(), {("u:A", "u:F"): "u:attends", ("u:F", "u:A"): "u:never"}).collect()
    assert [(r.s, r.p, r.o) for r in links] == [("Iu:a", "Iu:attends", "Iu:f")]


def test_relations_and_identifiers(spark):
    rows = [("a", "owns", "b", None), ("a", "near", "c", datetime(2030, 1, 1)), ("a", "owns", "d", datetime(2020, 1, 1))]
    live = related(spark.createDataFrame(rows, "source string, kind string, target string, expires timestamp"), spark.createDataFrame([("owns", "owned by")], "kind string, inverse string"), "2025-01-01")
    assert {tuple(r) for r in live.collect()} == {("a", "owns", "b", "out"), ("b", "owned by", "a", "in"), ("a", "near", "c", "out"), ("c", "near", "a", "in")}
    ids = spark.createDataFrame([("a", "LEI", "X1"), ("a", "LEI", "x1"), ("b", "VAT", "x1")], "entity string, namespace string, value string")
    assert [r.entity for r in by_identifier(ids, "LEI", "x1").collect()] == ["a"]


def test_fuzzy(spark):
    assert fuzzy.indel_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert fuzzy.pair_score("Smith John", "john smith") == 100
    names = spark.createDataFrame([(1, "Acme Corporation"), (2, "ACME Corporatoin"), (3, "Zenith"), (4, "acme corporation ")], "id int, name string")
    assert {r.id for r in fuzzy.find_similar(names, "Acme Corporation", 85).collect()} == {1, 2, 4}
    assert {(r.a, r.b) for r in fuzzy.duplicates(names, 85).collect()} == {(1, 2)}
    words = spark.createDataFrame([("smith", w) for w in ("smih", "smtih", "smitth", "smyth", "smith", "smythe", "mith", "htims")], "a string, b string")
    assert {r.b for r in words.where(fuzzy.one_edit_apart(words["a"], words["b"])).collect()} == {"smih", "smtih", "smitth", "smyth", "mith"}
    sounds = spark.createDataFrame([("Knight",), ("Philip",), ("Thumb",), ("Catch",), ("Wright",)], "w string")
    assert [r.m for r in sounds.select(fuzzy.metaphone(sounds["w"]).alias("m")).collect()] == ["NT", "FLP", "0M", "KX", "RT"]
    long = spark.createDataFrame([(1, "the very long trading name of a compny whose words are many"), (2, "unrelated")], "id int, name string")
    assert {r.id for r in fuzzy.find_similar(long, "company", 0).collect()} == {1}


def test_candidates_are_found_by_the_same_numbers_in_python(spark):
    import random

    draw = random.Random(5)
    names = ["", " ", "ab", "Ñandú  Straße 東京", "Customer#000000012", "x" * 40]
    names += ["".join(draw.choice("abcdefghiklmnoprstwyxhHKGCSTE zé12") for _ in range(draw.randint(1, 24))) for _ in range(150)]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    asked = fuzzy.signed(rows.where("name like 'Customer%'"), "name").select("_signature", F.array(*(F.xxhash64(F.lit(i)) for i in range(64))).alias("starts")).first()
    codes = ["SC235", "MKSTMR", "SS300", "MST"]
    want = fuzzy.bands(F.array(*map(F.lit, asked["_signature"])))
    native = F.size(F.array_intersect(fuzzy.bands(F.col("_signature")), want)).alias("hits")
    both = fuzzy.signed(rows, "name").select("name", native, F.arrays_overlap(fuzzy.phonetic(F.col("name")), F.array(*map(F.lit, codes))).alias("sounds"), fuzzy.phonetic(F.col("name")).alias("codes"))
    own = rows.select("name", fuzzy.shared_bands(asked["_signature"], asked.starts)(fuzzy.plain_text(F.col("name"))).alias("hits"), fuzzy.sounding_like(codes)(F.col("name")).alias("sounds"))
    first = both.collect()
    assert sorted(tuple(r)[:3] for r in first) == sorted(map(tuple, own.collect())) and max(r.hits for r in first) == 32
    for r in first:
        assert set(r.codes) == set().union(*map(fuzzy.sounds_of, re.findall("[A-Za-z]+", r["name"])))


def test_duplicates_of_names_that_are_all_alike(spark):
    words = ["Supplier", "Inc", "of", "Übersee", "a"]
    rows = [(i, f"Supplier#{i:09d}") for i in range(300)] + [(1000 + i, f"{i:09d} supplier") for i in range(300)]
    rows += [(2000 + i, " ".join(words[(i >> b) % 5] for b in range(i % 4 + 1)) + "!" * (i % 3)) for i in range(40)]
    rows += [(3000, "supplier 000000007 and sons of the sea"), (3001, "###"), (3002, None)]
    names = spark.createDataFrame(rows, "id int, name string")
    first = {}
    for i, n in rows:
        if n is not None:
            first.setdefault(n.strip().lower(), i)
    every = sorted((i, n) for n, i in first.items())
    want = {(a, b) for k, (a, x) in enumerate(every) for b, y in every[k + 1 :] if fuzzy.pair_score(x, y) >= 99}
    got = [(r.a, r.b) for r in fuzzy.duplicates(names, 99.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (7, 3000) in want
    # as many candidates as names, not as pairs of names
    alike = spark.range(2000).select(F.format_string("%09d supplier", "id").alias("text")).withColumn("words", F.split("text", " "))
    assert fuzzy.sharing_words(alike, 99.0).count() == 0


def test_tables_mapped_to_a_graph_are_read_in_place(spark):
    sf_dir = "/root/testdata/sf0.001"
    store = kg_catalog.graph(spark, sf_dir)
    made = {"edges": D.edges(store.quads()), "slots": D.slots(store.quads(), SLOT_PROPERTIES)}
    for name, rows in made.items():
        kept = store.derived[name]
        assert kept.count() == rows.count() > 0 and D.drift(kept, rows, rows.columns).isEmpty()
    # nothing is copied, and of the tables only those are read that have the predicates
    page = kg_catalog.QUERIES["kg_entities_page"](spark, sf_dir)
    assert {f.rsplit("/", 1)[1] for f in page.inputFiles()} <= {"customer.parquet", "nation.parquet"}
    assert all(f.startswith("file:" + sf_dir) or f.startswith("file://" + sf_dir) for f in page.inputFiles())


def test_same_as(spark):
    links = spark.createDataFrame([("a", "b", False), ("b", "c", False), ("x", "y", True)], "source string, target string, retracted boolean")
    assert {tuple(r) for r in canonical(links).collect()} == {("a", "c"), ("b", "c")}
    circle = spark.createDataFrame([("a", "b", False), ("b", "a", False)], "source string, target string, retracted boolean")
    with pytest.raises(ValueError):
        canonical(circle)


def test_hybrid(spark):
    a, b = spark.createDataFrame([("x", 1.0)], "entity string, score double"), spark.createDataFrame([("y", 0.5)], "entity string, score double")
    assert {tuple(r) for r in hybrid(a, b).collect()} == {("x", 0.5), ("y", 0.25)}


def test_documents():
    assert to_markdown("<h1>A</h1><script>x</script><p>b <b>c</b> &amp; d</p>") == "# A\n\nb **c** & d"
    assert segments(None) == [] and segments("# H\n" + "w " * 60)[0][1] == "H"
    assert all(len(p.split()) <= 5 for p in pieces("a b c. d e f g. " * 4, 5))


def test_rollup_stream_equals_batch(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 3, i), "a" if i % 2 else "b", float(i)) for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "events"))
    got = stream_to_table(spark, str(tmp_path / "events"), events.schema, "rolled", str(tmp_path / "check"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rollup(events).collect()))


def files_of(folder):
    return {str(f.relative_to(folder)): f.stat().st_mtime_ns for f in folder.rglob("*.parquet") if f.is_file()}


def test_space_writes_deltas_and_keeps_derived_tables(spark, tmp_path, monkeypatch):
    """One triple does not rewrite the space; edges, slots and counts equal those derived anew after every write."""
    from quadrille.functions import terms as T
    from quadrille.operators import derived as D
    from quadrille.operators import spaces as P

    monkeypatch.setattr(P, "MOST_DELTAS", 3)
    s = Space(spark, str(tmp_path), "d").create()
    s.update(
        f"""INSERT DATA {{ <urn:e1> <{D.EDGE_SOURCE}> <urn:f> ; <{D.EDGE_DEST}> <urn:s1> . <urn:s1> <{D.SLOT_TYPE}> <urn:total> ; <{P.VALUE_PROPERTIES[int]}> 5 .
        <urn:e2> <{D.EDGE_SOURCE}> <urn:f> ; <{D.EDGE_DEST}> <urn:s2> . <urn:s2> <{D.SLOT_TYPE}> <urn:status> }}"""
    )
    s.compact()
    steps = [
        "INSERT DATA { <urn:x> <urn:p> 1 }",
        f"DELETE DATA {{ <urn:s1> <{P.VALUE_PROPERTIES[int]}> 5 }} ; INSERT DATA {{ <urn:s1> <{P.VALUE_PROPERTIES[int]}> 6 }}",
        f"DELETE {{ <urn:e2> <{D.EDGE_DEST}> ?d }} INSERT {{ <urn:e2> <{D.EDGE_DEST}> <urn:s1> }} WHERE {{ <urn:e2> <{D.EDGE_DEST}> ?d }}",
        "INSERT DATA { <urn:x> <urn:p> 1 } ; DELETE DATA { <urn:none> <urn:p> 1 }",
        "CLEAR DEFAULT",
    ]
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    for step in steps:
        before, base = files_of(tmp_path / "d"), s.manifest().base
        s.update(step)
        if s.manifest().base == base:
            assert set(before) <= set(files_of(tmp_path / "d")) and all(files_of(tmp_path / "d")[f] == t for f, t in before.items())
        q = s.quads()
        assert rows(q) == rows(q.distinct())
        assert rows(s.edges().select("edge", "source", "dest", "g")) == rows(D.edges(q))
        assert rows(s.slots().select("frame", "slot", "slot_type", "property", "value", "g")) == rows(D.slots(q, P.SLOT_PROPERTIES))
        assert rows(s.statistics()) == rows(D.predicate_stats(q))
        if step == steps[0]:
            assert s.manifest().base == base and ("Iurn:x", "Iurn:p", T.integer(1)) in {tuple(r)[:3] for r in q.collect()}
    assert s.quads().isEmpty()
    before = files_of(tmp_path / "d")
    s.add_namespace("u", "urn:u:")
    assert files_of(tmp_path / "d") == before and s.manifest().namespaces == {"u": "urn:u:"}
    late = s.manifest()
    late.version += 1
    s._publish(late)
    with pytest.raises(Exception):
        s._publish(late)


def test_objects_are_created_replaced_and_removed(spark):
    from quadrille.functions import terms as T
    from quadrille.operators import derived as D
    from quadrille.operators import kgobjects as O
    from quadrille.operators import kgquery as K
    from quadrille.sources.store import DEFAULT_GRAPH, QUAD_SCHEMA

    i = T.iri

    def graph(*rows):
        return spark.createDataFrame([(i(s), i(p), o, DEFAULT_GRAPH) for s, p, o in rows], QUAD_SCHEMA)

    def edge(name, a, b):
        return [(name, D.EDGE_SOURCE, i(a)), (name, D.EDGE_DEST, i(b))]

    e, f, s = ("u:e", T.RDF_TYPE, i(K.ENTITY)), ("u:f", K.FRAME_TYPE, i("u:F")), ("u:s", D.SLOT_TYPE, i("u:S"))
    quads = graph(e, f, s, *edge("u:ef", "u:e", "u:f"), *edge("u:fs", "u:f", "u:s"))
    assert O.invalid(quads).isEmpty()
    assert {(r.entity, r.node) for r in O.graph_members(quads).collect()} == {(i("u:e"), i(x)) for x in ("u:e", "u:f", "u:s", "u:ef", "u:fs")}
    bad = quads.unionByName(graph(("u:g", K.FRAME_TYPE, i("u:F")), ("u:h", D.EDGE_SOURCE, i("u:nowhere")), ("u:e2", T.RDF_TYPE, i(K.ENTITY)), *edge("u:e2f", "u:e2", "u:f")))
    problems = O.invalid(bad, D.edges(bad)).collect()  # with the edge table at hand the same, each once
    assert sorted(map(tuple, problems)) == sorted(map(tuple, O.invalid(bad).collect()))
    assert {(r.node, r.problem) for r in O.invalid(bad).collect()} == {(i("u:g"), "orphan"), (i("u:h"), "dangling"), (i("u:h"), "half"), (i("u:f"), "shared"), (i("u:s"), "shared")}
    assert O.remove(quads, spark.createDataFrame([(i("u:e"),)], "s string")).isEmpty()
    assert O.remove(quads, spark.createDataFrame([(i("u:s"),)], "s string")).count() == 4
    with pytest.raises(ValueError):
        O.create(quads, graph(("u:e", D.NAME, T.literal("x"))))
    new = O.replace(quads, graph(("u:f", K.FRAME_TYPE, i("u:G"))))
    assert {r.o for r in new.where(new.s == i("u:f")).collect()} == {i("u:G")}
    with pytest.raises(ValueError):
        O.replace(quads, graph(("u:none", D.NAME, T.literal("x"))), upsert=False)
