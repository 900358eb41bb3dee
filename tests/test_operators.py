import random

import pytest
from pyspark.sql import functions as F

from loomstack.functions.text import name_key
from loomstack.operators import chunking, evaluation, extraction, graph, repair, resolution, retrieval, vector
from loomstack.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = spark.createDataFrame([(f"d:{i:04d}", "d", i, i, i, f"passage {i}") for i in range(12)], "id string, document string, page_start int, page_end int, ordinal int, text string")
    vectors = spark.createDataFrame([(f"d:{i:04d}", [1.0, i / 10]) for i in range(12)] + [("lost:0001", [1.0, 0.0]), ("null:1", None)], "id string, embedding array<double>")
    return chunks, vectors, spark.createDataFrame([(1, [1.0, 0.0])], "qid int, embedding array<double>")


def test_vector_arm_orders_hits_and_drops_orphans(corpus):
    chunks, vectors, queries = corpus
    hits = retrieval.retrieve(queries, vectors, chunks, 5).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits] == [f"d:{i:04d}" for i in range(4)]  # the orphan took one of five places
    assert [h["rank"] for h in hits] == [1, 2, 3, 4]


def test_arguments_are_checked(corpus):
    chunks, vectors, queries = corpus
    for k in (0, 51, 1.5, "10", True):
        with pytest.raises(ValueError, match="k must"):
            retrieval.retrieve(queries, vectors, chunks, k)
    with pytest.raises(ValueError, match="arm"):
        retrieval.retrieve(queries, vectors, chunks, 5, "magic")
    with pytest.raises(ValueError, match="cap"):
        retrieval.retrieve(queries, vectors, chunks, 36, "vector_rerank")


def test_a_wrong_width_fails(corpus):
    with pytest.raises(Exception, match="3 wide"):
        vector.checked(corpus[1].filter("embedding IS NOT NULL"), "embedding", 3).collect()


def test_reranked_hits_are_sorted_and_single(corpus, spark):
    chunks, vectors, queries = corpus
    twice = lambda c: c.withColumn("rerank_score", F.col("pos").cast("double")).unionByName(c.withColumn("rerank_score", F.lit(-1.0)))
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    nodes = spark.createDataFrame([("a", "d:0000"), ("b", "d:0011")], "node_id string, chunk_id string")
    hits = retrieval.retrieve(queries, vectors, chunks, 3, "graph2", edges, nodes, reranker=twice).orderBy("rank").collect()
    assert len({h["chunk_id"] for h in hits}) == 3
    assert [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)


def test_walk_reaches_two_hops_and_near_chunks_come_first(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("z", "z")], "source string, target string")
    nodes = spark.createDataFrame([(n, f"c{n}") for n in "abcdz"], "node_id string, chunk_id string")
    seeds = spark.createDataFrame([(1, "ca")], "qid int, chunk_id string")
    assert rows(graph.walk(edges, nodes, seeds).select("chunk_id", "min_hop")) == [("ca", 0), ("cb", 1), ("cc", 2)]
    assert rows(graph.walk(edges, nodes, seeds.limit(0))) == []
    many = nodes.union(spark.createDataFrame([("a", f"x{i:02d}") for i in range(25)], nodes.schema))
    assert {r["min_hop"] for r in graph.walk(edges, many, seeds).collect()} == {0}
    assert {r["min_hop"] for r in graph.walk(edges, many, seeds, per_hop=5).collect()} == {0, 1, 2}
    assert rows(graph.walk(edges, nodes, seeds, through=1).select("chunk_id", "min_hop")) == [("ca", 0), ("cb", 1)]


def test_walk_leaves_chunks_out_that_their_like_precede(spark):
    rng = random.Random(5)
    chunks = [f"c{i:03d}" for i in range(300)]
    stands = [(n, c) for c in chunks for n in rng.choice(["a", "b", "ab", "abc", "cde", "e"])] + [("a", None), (None, "c000"), ("a", "c001"), ("a", "c001")]
    nodes = spark.createDataFrame(stands, "node_id string, chunk_id string")
    assert max(r["count"] for r in graph.foremost(nodes, 7).groupBy("node_id").count().collect()) <= 7 * 5
    edges, ways = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], {}
    for u, v in edges:
        ways.setdefault(u, set()).add(v), ways.setdefault(v, set()).add(u)
    asked = [(q, rng.choice(chunks)) for q in range(8)]
    for per_hop in (None, 3, 9):
        wanted = []
        for q, seed in asked:
            hop, own = dict.fromkeys((n for n, c in stands if c == seed and n), 0), {}
            for h in (1, 2):
                hop |= {b: h for a in list(hop) for b in ways[a] if b not in hop}
            for n, c in {(n, c) for n, c in stands if n in hop}:
                own.setdefault(c, []).append(hop[n])
            order, used = sorted((min(h), -len(h), c or "", c) for c, h in own.items()), {}
            order = [o for o in order if used.update({o[0]: used.get(o[0], 0) + 1}) or per_hop is None or used[o[0]] <= per_hop]
            wanted += [(q, i + 1, c, h, -n) for i, (h, n, _, c) in enumerate(order[:7])]
        got = graph.walk(spark.createDataFrame(edges, "source string, target string"), nodes, spark.createDataFrame(asked, "qid int, chunk_id string"), limit=7, per_hop=per_hop)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == wanted


def test_degrees_and_isolated_nodes(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("q",)], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b")], "source string, target string")
    assert rows(graph.degrees(nodes, edges)) == [("a", 2), ("b", 2), ("q", 0)]
    assert rows(graph.isolated(nodes, edges)) == [("q",)]


def test_components_of_a_long_path(spark):
    pairs = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(40) if i != 20], "a string, b string")
    got = dict(rows(graph.components(spark.createDataFrame([("zz",)], "key string"), pairs)))
    assert got["020"] == "000" and got["040"] == "021" and got["zz"] == "zz"


RECORD = readers.EXTRACTION
KEPT_OF_RECORD = "chunk string, status string, extraction struct<entities: array<struct<name: string, type: string, description: string, aliases: array<string>>>, relations: array<struct<source: string, target: string, relation: string, evidence: string>>>"


def record(chunk, entities, relations=(), status="ok"):
    return (chunk, "m", "b", status, None, {"entities": [dict(zip(("name", "type", "description", "aliases"), e, strict=True)) for e in entities], "relations": [dict(zip(("source", "target", "relation", "evidence"), r, strict=True)) for r in relations]}, {}, {}, None, 1)


def test_graph_building(spark):
    records = spark.createDataFrame([
        record("a:0001", [("Mars Lander", "spacecraft", "short", ["ML-1 craft"]), ("mars lander", "person", "", []), ("", "person", "x", []), ("Board", "board", "", ["Mars Lander"]), ("Jet Lab", "ufo", "", [])], [("MARS LANDER", "Jet Lab", "Built By!", "e"), ("Mars Lander", "nobody", "x", "")]),
        record("b:0001", [("ML 1 Craft", "spacecraft", "a longer text", []), ("Jet Lab", "facility", "", None), ("Board", "board", "", [])], [("ML 1 Craft", "jet lab", "built by", "e")]),
        record("b:0002", [("Lost", "person", "", [])], status="failed"),
    ], RECORD)
    built = resolution.build(records)
    nodes = {r["id"]: r for r in resolution.node_records(built).collect()}
    assert set(nodes) == {"ml-1-craft", "jet-lab", "board"}
    lander = nodes["ml-1-craft"]
    assert (lander["type"], lander["description"], lander["mentions"], lander["documents"]) == ("spacecraft", "a longer text", 2, ["a", "b"])
    assert lander["aliases"] == ["ML-1 craft", "Mars Lander"]
    assert nodes["jet-lab"]["type"] == "facility" and nodes["jet-lab"]["description"] is None  # other comes last in a tie
    assert rows(built.edges.select("source", "target", "relation", "chunk_id")) == [("ml-1-craft", "jet-lab", "built_by", "a:0001"), ("ml-1-craft", "jet-lab", "built_by", "b:0001")]
    assert rows(built.node_chunks) == [("board", "a:0001"), ("board", "b:0001"), ("jet-lab", "a:0001"), ("jet-lab", "b:0001"), ("ml-1-craft", "a:0001"), ("ml-1-craft", "b:0001")]


def test_records_are_repaired_where_they_are(spark):
    """One pass keeps what the entity and relation tables keep, odd texts and chunks of several records included."""
    rng = random.Random(3)
    names = ["Part 1", " part 1\x1f", "PART 1", "P-1", "the Acme Co", "Acme", "ACME Inc ltd", "Straße 9", "STRASSE 9", "\u2003Ñandú_x", "--", "", " ", None, "a", "co", "the", "İx", "x/y", "x y"]
    made = [lambda: rng.choice(names), lambda: rng.choice(["Person", " event ", "ALIEN", None, "ſoftware"]), lambda: rng.choice([None, "", " d ", "text"]), lambda: rng.choice([None, [], [rng.choice(names) for _ in range(4)]])]
    tie = [made[0], made[0], lambda: rng.choice([None, "Made By!", "__", "ﬁts in", "of"]), made[2]]
    listed = lambda of, n: rng.choice([None, [], *[[tuple(f() for f in of) for _ in range(rng.randrange(n))] for _ in range(6)]])
    own = [(f"d:{i}", rng.choice(["ok", None, "failed"]), rng.choice([None, *[(listed(made, 24), listed(tie, 24)) for _ in range(9)]])) for i in range(150)]
    records = spark.createDataFrame(own, KEPT_OF_RECORD)
    entities = resolution.repaired_entities(records)
    wanted = [(r.chunk, r.name, r.key, r.type, r.description, tuple(r.aliases)) for r in resolution.mentions(entities).collect()]
    got = resolution.kept(records).collect()
    assert sorted((r.chunk, r.name, r.key, r.type, r.description, tuple(r.aliases)) for r in got if r.key is not None) == sorted(wanted) and len(wanted) > 100
    ties = resolution.repaired_relations(records, entities).filter("fault IS NULL").select("chunk", name_key("source"), name_key("target"), "relation", "evidence")
    assert sorted((r.chunk, r.source, r.target, r.relation, r.evidence) for r in got if r.source is not None) == rows(ties) and len(rows(ties)) > 20
    halves = [(c, s, (half(e[0]), half(e[1]))) for c, s, e in own if e and s != "failed" for half in (lambda x: x and x[: len(x) // 2], lambda x: x and x[len(x) // 2 :])]
    apart = resolution.kept(spark.createDataFrame(halves, KEPT_OF_RECORD)).collect()
    assert sorted((r.chunk, r.key, r.source or "", r.target or "") for r in apart if r.key is None) == sorted((r.chunk, r.key, r.source, r.target) for r in got if r.key is None)
    assert len(apart) == len(got)


def test_a_graph_moves_each_mention_once_and_counts_without_lists(spark):
    """Mentions, which outnumber all else, are repaired without a shuffle and met by one join; counts equal the lists."""
    own = [(f"d{i % 3}:{i}", "ok", ([(f"Part {i % 7}", "event", "x" * (i % 5), [f"P-{i % 7}"]), (f"Supplier {i % 9}", "person", "", [f"House {i % 2}"])], [(f"part {i % 7}", f"Supplier {i % 9}", "made by", "e")])) for i in range(60)]
    records = spark.createDataFrame(own, KEPT_OF_RECORD)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(resolution.kept(records))
    built = resolution.build(records)
    assert plan(built.edges).count("SortMergeJoin") == 0 == plan(built.node_chunks).count("SortMergeJoin")
    full = {r["id"]: r for r in resolution.node_records(built).collect()}
    for r in resolution.node_counts(built).collect():
        whole = full.pop(r["id"])
        assert (r["chunks"], r["documents"], r["aliases"], r["mentions"]) == (len(whole["chunks"]), whole["documents"], whole["aliases"], whole["mentions"])
    assert not full and "description" not in plan(resolution.types_summary(built.kinds))
    assert rows(resolution.types_summary(built.kinds)) == rows(resolution.types_summary(built.nodes))


def test_node_chunks_come_from_names_and_aliases_alone(spark):
    """The pairs of the whole graph, odd names, alike keys in a chunk and chunks of several records included."""
    rng = random.Random(5)
    names = ["Part 1", " part 1\x1f", "P-1", "the Acme Co", "Acme", "ACME Inc ltd", "Straße 9", "STRASSE 9", "Ñandú_x", "--", "", None, "co", "x/y", "x y", "lab", "12345"]
    some = lambda n: rng.choice([None, *[[rng.choice(names) for _ in range(n)] for _ in range(3)]])
    own = [(f"d:{i % 90}", rng.choice(["ok", None, "failed"]), rng.choice([None, *[([(n, "Person", "text", some(2)) for n in some(5) or ()], None) for _ in range(6)]])) for i in range(100)]
    records = spark.createDataFrame(own, KEPT_OF_RECORD)
    got = resolution.node_chunks(records)
    assert rows(got) == rows(resolution.build(records).node_chunks) and got.count() > 50
    apart = [r for r in resolution.whole(records).select("chunk", "extraction.entities.name", "extraction.entities.aliases").mapInArrow(repair.mentioned, repair.MENTIONED).collect()]
    whole = [r for r in resolution.kept(records).collect() if r.key is not None]
    assert sorted((r.chunk, r.key) for r in apart) == sorted((r.chunk, r.key) for r in whole)
    assert any(r.again for r in apart) and len({(r.chunk, r.key) for r in apart}) == sum(not r.again for r in apart)
    pairs = {(r.key, tie) for r in apart for tie in r.ties.split("\n") if tie}
    assert {tuple(r) for r in resolution.alias_pairs(spark.createDataFrame(whole, repair.KEPT)).collect()} == {(a, b) for a, b in pairs if not {a, b} & {"co", "lab", "12345"}}


def test_a_graph_replaces_the_old_one_whole(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    for name in ("One", "Other"):
        records = spark.createDataFrame([record("a:1", [(name, "person", "", ["Too"]), ("Jet Lab", "facility", "it", [])], [(name, "Jet Lab", "leads", "")])], RECORD)
        sinks.replace_graph(resolution.build(records), path)
    assert rows(spark.read.parquet(f"{path}/nodes").select("id", "description").na.fill("-")) == [("jet-lab", "it"), ("other", "-")]
    assert rows(spark.read.parquet(f"{path}/aliases")) == [("other", "Too")] and spark.read.parquet(f"{path}/edges").count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["graph"]


def test_numbered_ids_stay_unique(spark):
    groups = spark.createDataFrame([("r1", "x"), ("r2", "X"), ("r3", "x 2"), ("r4", "x!")], "root string, name string")
    got = dict(rows(resolution.unique_ids(groups)))
    assert got["r1"] == "x" and got["r3"] == "x-2" and len(set(got.values())) == 4


def test_pages_to_chunks(spark):
    text = "\f--- page 1 ---\n" + "\n\n".join(f"Paragraph {i} says something rather long. It has two\nsentences." * 3 for i in range(12)) + "\n\f--- page 2 ---\nskipped\n\f--- page 3 ---\nThe end. " + "x" * 3000
    pages = chunking.split_pages(spark.createDataFrame([("d", text)], "document string, text string"))
    assert [r["page"] for r in pages.orderBy("seq").collect()] == [1, 2, 3]
    got = chunking.chunk(pages, spark.createDataFrame([("d", 2)], "document string, page int")).orderBy("ordinal").collect()
    assert [g["id"] for g in got] == [f"d:{i:04d}" for i in range(len(got))]
    assert all(len(g["text"]) <= 1400 for g in got) and not any("skipped" in g["text"] for g in got)
    assert all(g["page_start"] == g["page_end"] for g in got)  # no chunk crosses the hole
    whole = " ".join(" ".join(text.split("\n", 1)[1].split("\f")[0].split()).split())
    assert all(" ".join(g["text"].split()) in whole for g in got if g["page_end"] == 1)


def test_ranks_and_tally(spark):
    quote = "abcdefghij" * 10
    hits = spark.createDataFrame([(1, 1, "nothing"), (1, 2, quote[:49]), (1, 3, quote[:50]), (2, 1, "x")], "qid int, rank int, text string")
    quotes = spark.createDataFrame([(1, quote, "answer"), (1, "nothing", "bridge"), (1, "nothing", "equivalent"), (2, quote, "answer"), (3, "", "answer")], "qid int, quote string, role string")
    best = evaluation.best_ranks(evaluation.first_ranks(hits, quotes))
    assert rows(best.na.fill(-1)) == [(1, 3, 1), (2, -1, -1), (3, -1, -1)]
    groups = spark.createDataFrame([(1, "g"), (2, "g"), (3, "h")], "qid int, `group` string")
    assert ("strict", "overall", 3, 1, 1) in rows(evaluation.tally(best, groups).select("rule", "group", "n", "found_at_low", "found_at_high"))
    assert rows(evaluation.attribution(hits, quotes).select("qid", "rank", "label").na.fill("-")) == [(1, 1, "bridge"), (1, 2, "-"), (1, 3, "answer"), (2, 1, "-")]


def test_stated_quotes_meet_all_texts_in_blocks(spark):
    import random

    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    quotes = [(i, word(rng.randrange(0, 16)), "answer") for i in range(40)] + [(50, None, "bridge"), (51, "é  b" * 30, "bridge"), (51, "é  b" * 30, "bridge")]
    texts = [(i, word(rng.randrange(0, 40))) for i in range(60)] + [(70, None), (71, "é b" * 16), (72, "")]

    def holds(q, t):
        q, t = " ".join((q or "").split()), " ".join((t or "").split())
        half = -(-len(q) // 2)
        return bool(q) and any(q[i : i + half] in t for i in range(len(q) - half + 1))

    q, t = spark.createDataFrame(quotes, "qid int, quote string, role string"), spark.createDataFrame(texts, "rank int, text string")
    want = sorted((i, r) for i, quote, _ in quotes for r, text in texts if holds(quote, text))
    for size in (1 << 20, 50):
        assert rows(evaluation.met(t, q, size).select("qid", "_rank")) == want
    ranks = {(r["qid"], r["rank"]) for r in evaluation.first_ranks(t, q).collect()}
    assert ranks == {(i, min((r for j, r in want if j == i), default=None)) for i, _, _ in quotes}
    assert evaluation.met(t, q.limit(0)).count() == 0
    crossed = t.crossJoin(q.select("qid"))
    assert rows(evaluation.met(crossed.distinct(), q.distinct()).select("qid", "_rank")) == sorted(set(want))


def test_last_rows_resume_and_upsert(spark, tmp_path):
    log = spark.createDataFrame([("a", "failed", 1), ("a", "ok", 2), ("b", "failed", 3)], "chunk string, status string, seq long")
    assert rows(readers.done(log)) == [("a", "ok"), ("b", "failed")]
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(readers.todo(chunks, log)) == [("b",), ("c",)]
    path = f"file://{tmp_path}/t"
    for values in ([(1, "x"), (2, "y")], [(2, "z"), (2, "a"), (3, "w")]):
        sinks.upsert(spark.createDataFrame(values, "id int, v string"), path, "id")
    assert rows(spark.read.parquet(path)) == [(1, "x"), (2, "z"), (3, "w")]


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"documents": [{"slug": "d", "title": "D", "page_count": 1, "char_count": 3, "sha256": "00"}]}')
    (tmp_path / "d.txt").write_text("abc")
    (tmp_path / "c.jsonl").write_text('{"id": "a", "text": "x"}\n\n{"id": "b", "text": "y"}\n')
    expected = readers.manifest(spark, str(tmp_path / "m.json"))
    texts = readers.page_texts(spark, str(tmp_path / "d.txt"))
    pages = texts.select("document", F.lit(1).alias("page"), "text")
    assert rows(readers.integrity_faults(expected, pages)) == []
    assert rows(readers.integrity_faults(expected, pages, readers.digests(spark, str(tmp_path / "d.txt")))) == [("digest", "d")]
    lines = str(tmp_path / "c.jsonl")
    assert [r["id"] for r in readers.json_lines(spark, lines, readers.CHUNK, limit=1).collect()] == ["a"]
    with pytest.raises(ValueError, match="no record"):
        readers.json_lines(spark, lines, readers.CHUNK, only=["zz"])
    (tmp_path / "bad.json").write_text('{"documents": [}')
    with pytest.raises(Exception, match="MALFORMED"):
        readers.manifest(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError, match="missing"):
        readers.checked_columns(pages, "edges string")


def test_failed_extractions_are_records_and_stop_a_run(spark, tmp_path):
    class Broken:
        name, backend = "m", "test"

        def __call__(self, prompt):
            raise RuntimeError("no answer")

    chunks = spark.createDataFrame([(f"d:{i}", "d", 1, 2, "t") for i in range(6)], "id string, document string, page_start int, page_end int, text string")
    titles = spark.createDataFrame([("d", "Title")], "slug string, title string")
    path = f"file://{tmp_path}/log"
    assert extraction.run_in_batches(chunks, titles, Broken(), path) == 1
    first = spark.read.schema(extraction.RECORD).json(path)
    assert {r["status"] for r in first.collect()} == {"failed"}
    assert extraction.run_in_batches(chunks, titles, extraction.DryRun(), path) == 1
    assert {r["status"] for r in readers.done(spark.read.schema(extraction.RECORD).json(path)).collect()} == {"dry-run"}


def test_stream_ingest_repeats_nothing(spark, tmp_path):
    from loomstack.streaming.ingest import ingest_chunks

    (tmp_path / "in").mkdir()
    for n, line in enumerate(('{"id": "a", "text": "1"}', '{"id": "a", "text": "2"}\n{"id": "b", "text": "3"}')):
        (tmp_path / "in" / f"{n}.json").write_text(line)
        ingest_chunks(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("id", "text")) == [("a", "2"), ("b", "3")]


def test_longest_runs_meet_every_document(spark, tmp_path):
    from loomstack.plans.queries import QUERIES

    quotes = {0: "the red fox ran", 7: "over  the\nhill", 45: "far away", 80: "", 81: None}
    texts = {3: "a red fox ran over the hill", 5: "far from home", 47: "nothing", 85: None}
    spark.createDataFrame(list(quotes.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def run(q, t):
        q, t = (" ".join((x or "").split()) for x in (q, t))
        return max((b - a for a in range(len(q)) for b in range(a + 1, len(q) + 1) if q[a:b] in t), default=0), len(q)

    want = sorted((i, d, (n := run(q, t))[0], round(n[0] / n[1], 9) if n[1] else 0.0) for i, q in quotes.items() for d, t in texts.items())
    got = QUERIES["longest_runs"](spark, str(tmp_path)).collect()
    assert sorted((r["qid"], r["doc_id"], r["run"], round(r["held"], 9)) for r in got) == want


def test_runs_equal_brute_force(spark):
    import random

    from loomstack.functions.runs import Runs
    from loomstack.functions.text import _longest

    rng = random.Random(5)
    for _ in range(300):
        quotes = ["".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 6))]
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(25))) for _ in range(3)]
        search = Runs(quotes)
        assert [search.of(t) for t in texts] == [[_longest(q, t) for q in quotes] for t in texts]
    quotes = spark.createDataFrame([(i, "ab" * i) for i in range(5)], "qid int, quote string")
    texts = spark.createDataFrame([("x", "abab", None), ("x", None, 1)], "name string, text string, extra int")
    want = sorted((i, "x", e, n, n / max(2 * i, 1)) for i in range(5) for e, n in ((-1, min(4, 2 * i)), (1, 0)))
    for block in (1, 1 << 10):  # several blocks equal one
        assert rows(evaluation.runs(texts, quotes, block).fillna({"extra": -1})) == want
    assert evaluation.runs(texts, quotes.limit(0)).collect() == evaluation.runs(texts.limit(0), quotes).collect() == []


def test_embedding_is_cached_and_checked(spark, tmp_path):
    from loomstack.operators import embedding

    seen = str(tmp_path / "seen")

    class Counted(embedding.LetterCounts):
        def __call__(self, texts):
            with open(seen, "a") as out:
                out.write(f"{len(texts)}\n")
            return super().__call__(texts)

    chunks = spark.createDataFrame([(f"c{i}", f"a{'b' * i}") for i in range(7)] + [("n", None), ("c0", "a")], "id string, text string").coalesce(1)
    path = f"file://{tmp_path}/cache"
    calls = lambda: [int(x) for x in open(seen)]
    got = {r["id"]: r["values"] for r in embedding.embed_all(chunks, Counted(), path, batch=3).collect()}
    assert len(got) == 8 and got["c4"][:2] == [1.0, 4.0] and sum(got["n"]) == 0 and sum(calls()) == 8 and max(calls()) <= 3
    changed = chunks.filter("id <> 'c1'").withColumn("text", F.when(F.col("id") == "c2", "zz").otherwise(F.col("text")))
    got = {r["id"]: r["values"] for r in embedding.embed_all(changed, Counted(), path).collect()}
    assert sum(calls()) == 9 and got["c2"][25] == 2.0 and "c1" not in got

    class Narrow(embedding.LetterCounts):
        width = 5

    for wrong, said in ((Narrow(), "26 wide"), (type("Few", (embedding.LetterCounts,), {"__call__": lambda self, t: []})(), "0 vectors")):
        with pytest.raises(Exception, match=said):
            embedding.embed(chunks, wrong).collect()
    asked = retrieval.asked(spark.createDataFrame([(1, "abba")], "qid int, text string"), embedding.LetterCounts()).first()
    assert asked["embedding"][:2] == [2.0, 2.0]


def test_close_scores_are_ranked_in_full_precision(spark):
    data = [("a", [1.0, 2e-4]), ("b", [1.0, 1e-4]), ("c", [1e300, 0.0]), ("d", [0.0, 0.0]), ("e", [1e-300, 0.0])]
    got = vector.top_k(spark.createDataFrame(data, "id string, embedding array<double>"), spark.createDataFrame([(1, [1e200, 0.0])], "qid int, embedding array<double>"), 9).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["c", "e", "b", "a"] and got[0]["score"] == got[1]["score"] == 1.0


def test_calls_are_tried_again_only_where_it_may_help(spark):
    class Model:
        name, backend = "m", "test"

        def __init__(self):
            self.calls = {}

        def __call__(self, prompt):
            n = self.calls[prompt] = self.calls.get(prompt, 0) + 1
            if prompt == "busy" and n < 4:
                raise extraction.Passing("busy", 7.5 if n == 2 else None)
            if prompt == "down":
                raise extraction.Passing("down", 1000)
            if prompt == "refused":
                raise ValueError("no")
            if prompt == "odd":
                return ["a list"], "end", {}
            entities = [{"name": " Jet Lab ", "type": "Facility", "aliases": None}, {"name": "jet lab"}, {"name": ""}, "x", {"name": "Probe", "type": "ufo", "aliases": ["P", None]}, {"name": 5, "type": "person", "description": 1}]
            relations = [{"source": "JET LAB", "target": "probe", "relation": "Built!"}, {"source": "jet lab", "target": "Jet Lab", "relation": "is"}, {"source": "Probe", "target": "5", "relation": "!!"}, {"source": "Probe", "target": "none", "relation": "x"}, None]
            return {"entities": entities, "relations": relations, "more": 1}, "max_tokens" if prompt == "cut" else "end", {"tokens": 3, "tier": "high", "fast": True}

    waits = spark.sparkContext.accumulator(0.0)
    prompts = spark.createDataFrame([(p, p) for p in ("busy", "down", "refused", "odd", "cut")], "id string, prompt string").coalesce(1)
    records = extraction.extract(prompts, Model(), attempts=4, sleep=waits.add)
    got = {r["chunk"]: r for r in records.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"busy": "ok", "down": "failed", "refused": "failed", "odd": "failed", "cut": "truncated"}
    assert waits.value == (2 + 7.5 + 8) + 3 * 60 and got["odd"]["error"] == "the answer is no object"
    fine = got["busy"]
    assert fine["usage"] == {"tokens": 3} and fine["repairs"] == {"duplicate_entities": 1, "dropped_entities": 2, "retyped_entities": 1, "dropped_relations": 4}
    kept = resolution.repaired_entities(records.filter("chunk = 'busy'"))
    assert rows(kept.filter("fault IS NULL").select("name", "type")) == [("5", "person"), ("Jet Lab", "facility"), ("Probe", "other")]
    faults = {r["fault"]: r["count"] for r in kept.groupBy("fault").count().collect()}
    assert (faults["dropped"], faults["duplicate"], kept.filter("retyped").count()) == (2, 1, 1)
    relations = resolution.repaired_relations(records.filter("chunk = 'busy'"), kept)
    assert relations.filter("fault IS NULL").count() == 1 and relations.filter("fault = 'dropped'").count() == 4
    assert ("repairs.dropped_relations", 8) in rows(extraction.run_counters(records))


def test_names_fold_case_as_unicode_does(spark):
    own = record("a:1", [("Straße", "Facility ", "", ["STRASSE", "\tX\n", "x"])], [("STRASSE", "straße", "IST ẞ", "")])
    got = resolution.repaired_entities(spark.createDataFrame([own], RECORD)).first()
    assert (got["type"], got["aliases"], got["fold"]) == ("facility", ["X", "x"], "strasse")


def test_dropped_relations_have_a_reason(spark):
    own = record("a:1", [("Mars Lander", "spacecraft", "", ["ML-1 craft"]), ("ML-1 craft", "spacecraft", "", []), ("!!!", "other", "", []), ("Jet Lab", "facility", "", [])], [("Mars Lander", "ML-1 craft", "is", ""), ("Jet Lab", "!!!", "made", ""), ("Jet Lab", "Mars Lander", "made", "")])
    assert rows(resolution.build(spark.createDataFrame([own], RECORD)).dropped) == [("no_node", 1), ("same_node", 1)]


def test_the_last_row_wins_and_no_crash_loses_a_table(spark, tmp_path):
    old = spark.createDataFrame([(1, "x", {"a": 1}), (2, "y", None)], "id int, v string, m map<string,int>")
    new = spark.createDataFrame([(2, "z", {"b": 2}, 1), (2, "a", None, 2), (3, "w", None, 1)], "id int, v string, m map<string,int>, seq int")
    assert sorted((r["id"], r["v"]) for r in sinks.upserted(old, new, "id", seq="seq").collect()) == [(1, "x"), (2, "a"), (3, "w")]
    path = f"{tmp_path}/t"
    sinks.replace(old, f"file://{path}")
    (tmp_path / "t").rename(tmp_path / "t.aside")  # as if a crash came between the two renames
    sinks.upsert(new, f"file://{path}", "id", seq="seq")
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "t.aside").exists()
    vectors = spark.createDataFrame([("c", [1.0, 2.0]), ("c", [1.0, 2.0]), ("lost", [0.0, 0.0])], "id string, values array<double>")
    chunks = spark.createDataFrame([("c", "d", 1, 2)], "id string, document string, page_start int, page_end int")
    sinks.upsert_vectors(vectors, chunks, f"file://{path}v", 2)
    assert [(r["id"], r["metadata"]["page_end"]) for r in spark.read.parquet(f"{path}v").collect()] == [("c", 2)]
    with pytest.raises(Exception, match="3 wide"):
        sinks.upsert_vectors(vectors, chunks, f"file://{path}v", 3)


def test_records_keys_sources_and_the_verdict(spark, tmp_path):
    from pyspark.sql.types import StructType

    raw = spark.createDataFrame([(1, '{"id": "a", "kind": "k"}'), (2, '{"id": "a", "extra": 1}'), (3, "[]"), (4, None)], "n int, json string")
    found = evaluation.key_faults(raw, "n", "json", StructType.fromDDL("id string, kind string, hops string"), optional=("hops",))
    assert rows(found) == [("missing:kind", "2"), ("no_object", "3"), ("no_object", "4"), ("unknown:extra", "2")]
    (tmp_path / "e.json").write_text('{"amendment": 1, "passages": {"q1": [{"doc": "d", "page": 2, "quote": "so"}]}}')
    assert rows(readers.equivalents(spark, f"file://{tmp_path}/e.json")) == [("q1", 1, "d", 2, "so")]
    assert readers.equivalents(spark, f"file://{tmp_path}/none.json").count() == 0
    passages = spark.createDataFrame([("q1", "d"), ("q2", "z")], "id string, document string")
    assert rows(evaluation.unlisted_documents(passages, spark.createDataFrame([("d",)], "slug string"))) == [("document_unlisted", "q2")]
    skipped = []
    none, some = found.limit(0), found
    assert evaluation.verdict(lambda: none, lambda: none) == (0, None)
    assert evaluation.verdict(lambda: some, lambda: skipped.append(1))[0] == 1 and not skipped
    assert evaluation.verdict(lambda: none, lambda: some)[0] == 1
    assert evaluation.verdict(lambda: spark.read.json(f"file://{tmp_path}/nowhere.json")) == (2, None)
    (tmp_path / "bad.json").write_text('{"documents": [}')
    assert evaluation.verdict(lambda: readers.manifest(spark, str(tmp_path / "bad.json"))) == (2, None)
    with pytest.raises(Exception, match="no_such"):
        evaluation.verdict(lambda: none.select("no_such"))
    text = "".join(f"\f--- page {n} ---\n{t}\n" for n, t in ((1, "a"), (2, "b"), (1, "c")))
    pages = chunking.page_map(spark.createDataFrame([("d", text)], "document string, text string"))
    assert [(p, t.strip()) for _, p, t in rows(pages)] == [(1, "c"), (2, "b")]


def test_answers_are_picked_from_json(spark):
    from loomstack.functions import answers

    calls = '{"content": [{"type": "text"}, {"type": "tool_use", "name": "other", "input": {"a": 0}}, {"type": "tool_use", "name": "t", "input": "cut"}, {"type": "tool_use", "name": "t", "input": {"a": 1}}], "modelUsage": {"m": {}}}'
    df = spark.createDataFrame([(1, calls), (2, '{"modelUsage": {"m": 1, "n": 2}, "content": []}'), (3, "no json"), (4, None)], "n int, a string")
    got = df.orderBy("n").select(answers.call_input(F.col("a"), "t"), answers.sole_key(F.col("a"), "$.modelUsage")).collect()
    assert [tuple(r) for r in got] == [('{"a":1}', "m"), (None, None), (None, None), (None, None)]
    usage = spark.createDataFrame([('{"x": 3, "y": -4, "s": "high", "f": 1.5, "b": true, "o": {"z": 1}, "n": null}',), ("[]",), (None,)], "u string")
    assert [r[0] for r in usage.select(answers.counters(F.col("u"))).collect()] == [{"x": 3, "y": -4}, {}, {}]


def test_no_shared_folder_on_a_cluster_raises():
    from types import SimpleNamespace

    from loomstack.shared import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: ""), sparkContext=SimpleNamespace(master="spark://there:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(cluster)


def test_hot_keys_keep_every_link(spark):
    pairs = [("hub", f"n{i:03d}") for i in range(300)] + [(f"n{i:03d}", f"m{i:03d}") for i in range(0, 300, 3)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = dict(rows(graph.components(spark.createDataFrame([("alone",)], "key string"), spark.createDataFrame(pairs, "a string, b string"))))
    assert {got[k] for k in got if k[0] in "hnm"} == {"hub"} and len(got) == 1 + 300 + 100 + 4
    assert (got["x"], got["y"], got["z"], got["alone"]) == ("x", "x", "z", "alone")
    values = spark.createDataFrame([("a", 1, 90_000), ("b", 2, 1)], "k string, v int, n int")
    joined = graph.met(spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "k string, w int"), values, "k", "v", "n", 90_000)
    assert rows(joined) == [("a", 0, 1), ("b", 0, 2)]
