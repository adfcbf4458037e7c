"""Operators on small tables with known results: scores, walks, closures, time travel, the log, the stream."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.scores import bm25, cosine, query_terms, tokens
from tessera.operators import feedback, graph, retrieve, temporal
from tessera.operators.graph import Step
from tessera.sources.log import DimensionMismatch, MutationLog, UnknownTable
from tessera.streaming import changes


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [3.0, 4.0, 9.0]), (5, [])], "id int, v array<float>")
    for exact in (False, True):
        got = {r.id: round(r.s, 4) for r in df.select("id", cosine(F.col("v"), [3.0, 4.0], exact).alias("s")).collect()}
        assert got == {1: 0.6, 2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0}


def test_tokens_lower_ascii_only(spark):
    df = spark.createDataFrame([("Ünder-Ground É1, x_y",)], "t string")
    assert df.select(tokens(F.col("t"))).first()[0] == ["Ünder", "ground", "É1", "x", "y"]
    assert query_terms("B a b A!") == ["b", "a"]


def test_bm25_keeps_rows_without_match(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, None), (3, ""), (4, "red red hen")], "id int, text string")
    got = {r.id: r.score for r in bm25(df, "text", "red").collect()}
    assert got[2] == got[3] == 0 and got[1] > 0 and got[4] > got[1] * 0.9
    assert [r.score for r in bm25(df, "text", "!!").collect()] == [0.0] * 4


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ranks_equal_one_sorted_list(spark, parts):
    rows = [(i, [0.0, 0.5, 1.0, (i * 7919 % 101) / 100][i % 4]) for i in range(300)]
    got = {r.id: r.r for r in retrieve.ranks(spark.createDataFrame(rows, "id long, s double"), "s", "r", parts).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}


def test_unknown_sort_field(spark):
    with pytest.raises(retrieve.UnknownSortField):
        retrieve.order_by_field(spark.range(3), "nope")


def test_votes(spark):
    docs = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, created_at long")
    votes = spark.createDataFrame([(1, 1.0, None, 5), (1, -1.0, 0.5, 9), (2, 0.3, None, 9)], "dst long, value double, weight double, created_at long")
    by_id = lambda df: {r.id: round(r.score, 4) for r in df.collect()}
    assert by_id(feedback.laplace_score(docs, votes)) == {1: 0.625, 2: 0.4333, 3: 0.5}
    assert by_id(feedback.net_votes(docs, votes)) == {1: 0.0, 2: 0.0, 3: 0.0}
    assert by_id(feedback.decayed_feedback(docs, votes)) == {1: round(1 / 5 - 1, 4), 2: 0.0, 3: 0.0}
    ends = feedback.incident(spark.createDataFrame([("1", "1"), ("1", "2")], "src string, dst string"))
    assert sorted(r.id for r in ends.collect()) == ["1", "1", "2"]


@pytest.fixture
def small_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    rows = [(1, "e", "a", "b", 0.5), (2, "e", "a", "b", 0.9), (3, "e", "b", "c", None), (4, "e", "c", "a", 0.7), (5, "f", "a", "d", 0.1), (6, "e", "a", "zz", 1.0)]
    return nodes, spark.createDataFrame(rows, "seq long, name string, src string, dst string, weight double")


def test_match_and_count(small_graph):
    nodes, edges = small_graph
    walk = lambda *steps: {(r.id, r.score) for r in graph.match(nodes, edges, "a", list(steps)).collect()}
    assert walk(Step("e")) == {("b", 0.5)} and walk(Step(":f")) == {("d", 0.1)}
    assert walk(Step("e"), Step("e")) == {("c", 0.0)} and walk(Step("e"), Step("e"), Step("e")) == {("a", 0.0)}
    assert walk(Step("e", outgoing=False)) == {("c", 0.7)} and walk(Step("e", where=lambda e: F.col("weight") > 0.8)) == {("b", 0.9)}
    count = lambda start, *steps: int(graph.match_count(nodes, edges, start, list(steps)).first()[0])
    assert count("a", Step("e"), Step("e")) == 2 and count("none", Step("e")) == 0
    assert graph.match(nodes, edges, "none", [Step("e")]).collect() == []


def test_closure_ends_on_cycles_and_keeps_first_visits(small_graph):
    nodes, edges = small_graph
    out = graph.closure(nodes, edges, "a", [Step("e"), Step("e", outgoing=False)], lambda df: df.checkpoint())
    assert [(r.id, r.depth) for r in out.orderBy("depth", "visit").collect()] == [("a", 0), ("b", 1), ("c", 2)]


def test_log_time_travel_memories_and_pruning(spark, tmp_path):
    log = MutationLog(spark, f"file://{tmp_path}/log")
    log.create_table("t", 2)
    log.insert("t", [(1, {"a": 1}, [1.0, 0.0]), (2, {"a": 2})])
    log.relate("t:1", ":knows", "t:2", 0.5, since=3)
    log.insert("t", [(1, {"a": 9})])
    log.forget("t:2")
    bodies = lambda **k: {r.id: r.json for r in log.records("t", **k).collect()}
    assert bodies() == {"t:1": '{"a": 9}'} and bodies(as_of=4) == {"t:1": '{"a": 1}', "t:2": '{"a": 2}'}
    assert log.edges().count() == 0 and [(r.src, r.dst) for r in log.edges(as_of=4).collect()] == [("t:1", "t:2")]
    assert [(r.ts, r.kind) for r in log.history(2).orderBy("ts").collect()] == [(3, "INSERT"), (4, "RELATE"), (5, "INSERT"), (6, "FORGET")]
    log.memory("m").insert("t", [(7, {})])
    assert {r.id for r in log.records("t").collect()} == {"t:7"}
    log.memory()
    with pytest.raises(DimensionMismatch):
        log.insert("t", [(3, {}, [1.0])])
    with pytest.raises(UnknownTable):
        log.insert("nope", [(1, {})])
    log.prune()
    again = MutationLog(spark, f"file://{tmp_path}/log")
    assert {r.id: r.json for r in again.records("t", as_of=6).collect()} == {"t:1": '{"a": 9}'} and again.clock[""] == 6
    with pytest.raises(temporal.HistoryPruned):
        again.records("t", as_of=4)
    again.insert("t", [(5, {"a": None})])
    assert {r.id for r in again.records("t").collect()} == {"t:1", "t:5"}


def test_stream_of_changes(spark, tmp_path):
    from tessera.sources.log import SCHEMA

    log = MutationLog(spark, f"file://{tmp_path}/log")
    log.create_table("t")
    log.insert("t", [(1, {"a": 1}), (2, {})])
    log.forget("t:2")
    stream = changes.read_changes(spark, log._folder(), SCHEMA, files_per_trigger=1)
    q = changes.latest_state(stream, ["json"]).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.kind) for r in spark.table("latest").collect()} == {("t:1", "INSERT"), ("t:2", "FORGET")}


def test_ids_are_parsed_and_shown(spark):
    assert retrieve.parse_id("t:7") == ("t", 7) and retrieve.parse_id("t:a:b") == ("t", "a:b") and retrieve.parse_id("t:") is None and retrieve.parse_id("t") is None
    assert retrieve.parse_id(f"t:{2**64 - 1}") == ("t", 2**64 - 1) and retrieve.parse_id(f"t:{2**64}") == ("t", str(2**64)) and retrieve.parse_id("t:007") == ("t", 7)
    df = spark.createDataFrame([(7,), (-1,), (2**63 - 1,)], "id long")
    ids = lambda *x: sorted(r.id for r in retrieve.id_in(df, "t", list(x)).collect())
    assert ids("t:99999999999999999999", "t:7", "u:7", "t:007") == [7] and ids(f"t:{2**63}", f"t:{2**63 - 1}", "t:-1") == [-1, 2**63 - 1] and ids("t:x") == []
    assert retrieve.id_not(df, "t", "t:7").count() == 2 and retrieve.id_not(df, "t", "t:99999999999999999999").count() == 3 and retrieve.id_not(df, "t", "t:07").count() == 3


def test_scores_show_four_decimals_with_ties_to_even(spark):
    from tessera.functions.scores import four_decimals

    df = spark.createDataFrame([(0.03125,), (0.09375,), (1234.5,), (-0.00005,), (1 / 3,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(four_decimals(F.col("x"))).collect()] == ["0.0312", "0.0938", "1234.5000", "-0.0000", "0.3333", "NaN"]


def test_votes_have_their_name_with_or_without_colons(spark):
    edges = spark.createDataFrame([("voted", 1), (":voted", 2), ("::voted", 3), ("vote", 4)], "name string, dst long")
    assert sorted(r.dst for r in feedback.votes_of(edges).collect()) == [1, 2, 3] == sorted(r.dst for r in feedback.votes_of(edges, ":voted").collect())


def test_select_checks_its_clauses(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, None, 9), (3, [-1.0, 0.0], 7)], "id long, embedding array<float>, created_at long")
    got = lambda **k: [(r.id, r.score) for r in retrieve.select(df, **k).collect()]
    assert got(near=([1.0, 0.0], 2)) == [(1, 1.0), (2, 0.0)] and got() == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert got(near=([1.0, 0.0], 9), order=retrieve.Order("recency"), limit=2, offset=1) == [(3, -1.0), (1, 1.0)]
    for bad in ({"order": retrieve.Order("similarity")}, {"order": retrieve.Order("votes")}, {"near": ([1.0], 0)}, {"order": retrieve.Order("field", "nope")}):
        with pytest.raises(ValueError):
            retrieve.select(df, **bad)


@pytest.mark.parametrize("parts", [1, 5])
def test_texts_are_read_once_by_a_hybrid_query(spark, tmp_path, parts, monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS_A_TASK", 40 if parts > 1 else 10**6)
    rows = [(i, ["red fox", "blue hen", "red red", ""][i % 4] + f" w{i}", [float(i % 7) - 3, 1.0]) for i in range(120)]
    spark.createDataFrame(rows, "id long, text string, embedding array<float>").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = retrieve.hybrid(df, "text", "red hen", [1.0, 0.5], 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/t" not in plan and len({r.id for r in out.collect()}) == 10
    lexical = {r.id: r.score for r in bm25(df, "text", "red hen").collect()}
    semantic = {r.id: r.s for r in df.select("id", cosine(F.col("embedding"), [1.0, 0.5]).alias("s")).collect()}
    place = lambda s: {i: k + 1 for k, i in enumerate(sorted(s, key=lambda i: (-s[i], i)))}
    fused = {i: 1 / (60 + place(lexical)[i]) + 1 / (60 + place(semantic)[i]) for i in lexical}
    want = sorted(fused, key=lambda i: (-fused[i], i))[:10]
    assert [r.id for r in out.collect()] == want
    assert [r.text for r in retrieve.fetch(df, out, ["text"]).orderBy(F.col("score").desc(), "id").collect()] == [rows[i][1] for i in want]


def test_walks_over_typed_tables(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(40)], "id long").write.parquet(f"{tmp_path}/n")
    spark.createDataFrame([(i, i, i + 1, 0.5) for i in range(39)] + [(99, 3, 77, 0.1)], "seq long, src long, dst long, weight double").write.parquet(f"{tmp_path}/e")
    nodes = {"a": spark.read.parquet(f"{tmp_path}/n"), "b": spark.createDataFrame([("x",)], "id string")}
    next_ = graph.Edges("next", "a", "a", spark.read.parquet(f"{tmp_path}/e"))
    to_b = graph.Edges(":to_b", "a", "b", spark.createDataFrame([(200, 2, "x", 0.9), (201, 2, "gone", 0.2)], "seq long, src long, dst string, weight double"))
    edges = [next_, to_b]
    walk = lambda start, *steps: sorted((r.id, r.score) for r in graph.match(nodes, edges, start, list(steps)).collect())
    assert walk("a:1", Step("next"), Step("to_b")) == [("b:x", 0.9)] and walk("b:x", Step("to_b", outgoing=False), Step(":next", outgoing=False)) == [("a:1", 0.5)]
    assert walk("a:3", Step("next")) == [("a:4", 0.5)] and walk("a:99999999999999999999", Step("next")) == walk("c:1", Step("next")) == walk("a:1", Step("none")) == []
    assert int(graph.match_count(nodes, edges, "a:0", [Step("next")] * 3).first()[0]) == 1 and int(graph.match_count(nodes, edges, "a:77", [Step("next")]).first()[0]) == 0
    plan = graph.match(nodes, edges, "a:1", [Step("next")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(src,1)") >= 1 and plan.count("EqualTo(id,1)") >= 1
    chain = graph.closure(nodes, edges, "a:25", [Step("next"), Step("next", outgoing=False)], lambda df: df.checkpoint())
    depth = {r.id: r.depth for r in chain.collect()}
    assert len(depth) == 15 and depth["a:39"] == 14 and graph.closure(nodes, edges, "a:x", [Step("next")], lambda df: df).collect() == []


def test_visits_are_in_order_of_parents_and_edges(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    rows = [(5, "e", "a", "c"), (2, "e", "a", "b"), (9, "e", "b", "f"), (1, "e", "c", "g"), (3, "e", "c", "d"), (4, "e", "b", "d")]
    edges = spark.createDataFrame([(*r, None) for r in rows], "seq long, name string, src string, dst string, weight double")
    out = graph.closure(nodes, edges, "a", [Step("e")], lambda df: df.checkpoint())
    assert [r.id for r in out.orderBy("depth", "visit").collect()] == ["a", "b", "c", "d", "f", "g"]


def test_log_takes_frames_and_keeps_memories_apart(spark, tmp_path):
    log = MutationLog(spark, f"file://{tmp_path}/log")
    log.create_table("t", 2)
    rows = spark.createDataFrame([(k, float(k), None if k % 2 else "even", [1.0, 2.0]) for k in range(100)], "id long, value double, kind string, embedding array<double>").repartition(7)
    log.insert("t", rows.orderBy(F.col("id").desc()))
    got = {r.id: r for r in log.records("t").collect()}
    assert len(got) == 100 and log.clock[""] == 101 and [got[f"t:{k}"].created_at for k in (99, 98, 0)] == [2, 3, 101] and got["t:3"].json == '{"value": 3.0}'
    with pytest.raises(DimensionMismatch):
        log.insert("t", rows.withColumn("embedding", F.array(F.lit(1.0))))
    with pytest.raises(ValueError):
        log.insert("t", rows.withColumn("id", F.lit(None).cast("long")))
    log.memory("m").insert("t", [(1, {}, [1.0])])  # the dimension is the root's own
    log.relate_all(spark.createDataFrame([("t:1", "::knows", "t:2", 0.25, 4)], "src string, name string, dst string, WEIGHT double, since int"))
    log.relate("t:2", "knows", "t:3", Weight=2, note="x")
    assert [(r.name, r.weight, r.json) for r in log.edges().orderBy("seq").collect()] == [("knows", 0.25, '{"since": 4}'), ("knows", 2.0, '{"note": "x"}')]
    log.forget(spark.createDataFrame([("t:1",), ("t:none",)], "id string"))
    assert log.records("t").count() == 0 and log.clock["m"] == 5 and log.memory().records("t").count() == 100
    again = MutationLog(spark, log.path)
    assert again.clock == log.clock and again.dims == log.dims and again.declared == log.declared
    assert MutationLog(spark, f"file://{tmp_path}/none").mutations().collect() == []


def test_a_prune_that_was_lost_is_never_read(spark, tmp_path):
    log = MutationLog(spark, f"file://{tmp_path}/log")
    log.create_table("t")
    log.insert("t", [(1, {"a": 1}), (2, {"a": 2})])
    log.prune()
    log.insert("t", [(3, {})])
    (tmp_path / "log" / "base-000002").mkdir()  # killed before its first file
    (tmp_path / "log" / "base-000003" / "_temporary").mkdir(parents=True)
    again = MutationLog(spark, log.path)
    assert again.base == 1 and again.clock[""] == 4 and again.horizon[""] == 3 and {r.id for r in again.records("t").collect()} == {"t:1", "t:2", "t:3"}
    again.forget("t:1")
    again.prune()
    last = MutationLog(spark, log.path)
    assert last.base == 4 and {r.id for r in last.records("t").collect()} == {"t:2", "t:3"} and last.dims == {("", "t"): None}
    with pytest.raises(temporal.HistoryPruned):
        last.history(3)


def test_a_stream_goes_on_over_a_prune(spark, tmp_path):
    from tessera.sources.log import SCHEMA

    log = MutationLog(spark, f"file://{tmp_path}/log")
    log.create_table("t")
    stream = changes.read_changes(spark, log._folder(), SCHEMA)
    q = stream.writeStream.format("memory").queryName("over").option("checkpointLocation", f"{tmp_path}/cp").start()
    log.insert("t", [(1, {})])
    q.processAllAvailable()
    log.prune()
    log.insert("t", [(2, {})])
    q.processAllAvailable()
    q.stop()
    assert sorted(r.ts for r in spark.table("over").collect()) == [1, 2, 3]


def test_document_tables_project_and_guard_their_keys(spark, tmp_path):
    log = MutationLog(spark, f"file://{tmp_path}/log")
    log.create_table("t")
    log.insert("t", [(1, {"a": 2, "b": 1}), (2, {"a": "x"}), (3, {"c": None})])
    rows = log.records("t")
    assert [r.id for r in retrieve.order_by_key(rows, rows, "a").collect()] == ["t:3", "t:1", "t:2"]
    assert {r.id: sorted(r.body) for r in retrieve.project_body(rows, ["a", "c"]).collect()} == {"t:1": ["a"], "t:2": ["a"], "t:3": ["c"]}
    with pytest.raises(retrieve.UnknownSortField):
        retrieve.order_by_key(rows, rows, "nope")
    assert retrieve.order_by_key(rows.limit(0), rows, "nope").collect() == []


def test_an_index_is_written_once_a_version(spark, tmp_path):
    from tessera.operators.text_index import TextIndex

    rows = [(i, ["red fox", "blue hen red", None, "", "Red, red!"][i % 5]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string")
    path = f"file://{tmp_path}/index"
    index = TextIndex.of(df, "text", path, version=1)
    want = {r.id: round(r.score, 9) for r in bm25(df, "text", "red hen none").collect()}
    assert {r.id: round(r.score, 9) for r in index.scores("red hen none").collect()} == want
    assert sorted(r.id for r in index.matches("hen").collect()) == [i for i in range(50) if i % 5 == 1] and index.matches("!?").collect() == [] and index.matches("nope").collect() == []
    same = TextIndex.of(df.limit(1), "text", path, version=1)  # known for this version, so not written again
    assert same.scores("red").count() == 50 and TextIndex.of(df.limit(1), "text", path, version=2).scores("red").count() == 1
    plan = same.matches("hen")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "EqualTo(term,hen)" in plan


def test_postings_are_lists_of_a_terms_rows(spark, tmp_path):
    from tessera.operators.text_index import TextIndex

    df = spark.createDataFrame([(f"r{i}", "red fox red \u00e9t\u00e9" if i % 2 else None) for i in range(400)], "id string, text string").repartition(2)
    index = TextIndex.of(df, "text", f"file://{tmp_path}/index", version=1)
    stored = spark.read.parquet(f"file://{tmp_path}/index/text-1/postings").collect()
    assert len(stored) <= 3 * spark.sparkContext.defaultParallelism  # a row a term and task, not a row a term and text
    assert {r.term for r in stored} == {"red", "fox", "\u00e9t\u00e9"} and {t for r in stored if r.term == "red" for t in r.tfs} == {2}
    assert index.matches("red").count() == 200


def test_token_counts_equal_plain_ones(spark):
    from tessera.functions.scores import term_counts

    texts = ["", " ", "a", " a  b\tA ", "the-the THE_the", "\u0130a K\u212a k \u00c9 \u00e9", "x\u00e9a the\u00e9 the", None, "\n the\n", "a.b.c a"]
    for query in ("the a k i", "the a \u00e9"):
        terms = query_terms(query)
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        want = {r.id: r.k for r in df.select("id", tokens(F.col("t")).alias("k")).collect()}
        for r in term_counts(df, "t", terms, ["id"]).collect():
            k = want[r.id]
            assert (r.n, *r[2:]) == ((None,) * (len(terms) + 1) if k is None else (len(k), *(k.count(t) for t in terms))), (r, k)
