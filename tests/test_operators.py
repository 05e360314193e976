"""Operators on hand-made rows: semantics of scopes, ties, gates, budgets, layout, stores, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from skriva.engine import Engine
from skriva.operators import chunks as C
from skriva.operators import compare, evaluate, evidence, retrieval, store
from skriva.schemas import CASE, Params, validate
from skriva.sources import readers, sinks
from skriva.streaming import sequences

CHUNKS = "scope string, chunk_id string, position long, text string, section string, chunk_index int"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_chunks_cover_the_text(spark):
    text = "  " + " ".join(f"w{i}" for i in range(900)) + " \n"
    got = C.chunk_spans(spark.createDataFrame([(1, text), (2, " "), (3, None), (4, "x" * 1200)], "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    one = [r for r in got if r.doc_id == 1]
    assert [r.char_start for r in one] == [1050 * i for i in range(len(one))] and one[-1].char_end == len(text.strip())
    assert len([r for r in got if r.doc_id == 4]) == 1 and {r.doc_id for r in got} == {1, 4}


def test_scope_changes_the_statistics(spark):
    c = spark.createDataFrame([("a", "a1", 1, "cat dog", None, 1), ("a", "a2", 2, "dog dog", None, 2), ("b", "b1", 3, "cat", None, 1)], CHUNKS)
    q = spark.createDataFrame([(1, "a", "cat cat dog"), (2, "b", "cat"), (3, "b", "of the")], "query_id long, scope string, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(q, c).collect()}
    import math

    idf = lambda n, d: math.log(1 + (n - d + 0.5) / (d + 0.5))
    assert set(got) == {(1, "a1"), (1, "a2"), (2, "b1")}
    assert got[1, "a1"] == pytest.approx(2 * idf(2, 1) + idf(2, 2)) and got[2, "b1"] == pytest.approx(idf(1, 1))
    with pytest.raises(ValueError):
        retrieval.bm25(q, c, Params(b=2))


def test_ties_thresholds_and_nan(spark):
    s = spark.createDataFrame([(1, "x", 2, 0.5), (1, "y", 1, 0.5), (1, "z", 3, float("nan")), (1, "w", 4, 0.3), (1, "v", 5, -1.0)], "query_id long, chunk_id string, position long, score double")
    assert [r.chunk_id for r in retrieval.ranked(retrieval.positive(s, 0.3)).orderBy("rank").collect()] == ["y", "x", "w"]


def test_fusion_ignores_the_order_of_rankings(spark):
    a = spark.createDataFrame([(1, "x", 1, 1), (1, "y", 2, 2)], "query_id long, chunk_id string, position long, rank int")
    b = spark.createDataFrame([(1, "y", 2, 1), (1, "z", 3, 2)], "query_id long, chunk_id string, position long, rank int")
    assert rows(retrieval.rrf([a, b]), "chunk_id", "score") == rows(retrieval.rrf([b, a]), "chunk_id", "score")
    assert retrieval.ranked(retrieval.rrf([a, b]), 1).first().chunk_id == "y"


def test_gate(spark):
    r = spark.createDataFrame([(1, "a", 1, 1.0, 1, 0.2, 2), (1, "b", 2, 0.9, 2, 0.8, 1), (2, "c", 1, 1.0, 1, 0.1, 1)], "query_id long, chunk_id string, position long, score double, base_rank int, rerank_score double, rank int")
    assert rows(retrieval.gate(r, 0.5, 0.3), "query_id", "chunk_id") == [(1, "b")]
    assert rows(retrieval.gate(r, 0.5, 0.3, "shadow"), "query_id", "chunk_id", "rank") == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]
    assert rows(retrieval.rank_changes(r), "query_id", "rank_changes") == [(1, 2), (2, 0)]


def test_page_overlap(spark):
    p = spark.createDataFrame([(1, 2, None), (2, None, 5), (3, None, None), (4, 1, 9)], "id long, a int, b int")
    assert rows(p.where(retrieval.overlaps_pages(F.col("a"), F.col("b"), F.lit(2), F.lit(3))), "id") == [(1,), (4,)]


def test_neighbours_stay_in_their_section(spark):
    c = spark.createDataFrame([("d", f"c{i}", i, "t", "s1" if i < 3 else "s2", i) for i in range(1, 6)], CHUNKS)
    hits = c.where("chunk_id = 'c2'").withColumn("query_id", F.lit(1))
    assert rows(evidence.neighbours(hits, c), "relation", "chunk_id") == [("before", "c1")]


def test_evidence_budget_stops_at_the_first_misfit(spark):
    r = spark.createDataFrame([(1, 1, "a" * 40), (1, 2, "b" * 400), (1, 3, "c")], "query_id long, rank int, text string")
    got = evidence.evidence_budget(r, 60).orderBy("rank").collect()
    assert [(x.rank, x.whole) for x in got] == [(1, True), (2, False)] and got[1].text.endswith(" …")


def test_history(spark):
    m = spark.createDataFrame([(1, 1, "user", "old " * 50, None), (1, 2, "assistant", "draft", "failed"), (1, 3, "system", "s", None), (1, 4, "user", "new", None)], "conv_id long, turn long, role string, text string, status string")
    assert rows(evidence.history(m, budget=20), "turn") == [(4,)]
    long = spark.createDataFrame([(1, 1, "user", "x" * 500, None)], "conv_id long, turn long, role string, text string, status string")
    assert evidence.history(long, budget=20).first().text.endswith(" …")


def test_previous_turn_skips_equal_ones(spark):
    m = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(["a", "b", "b ", "b", "c"])], "conv_id long, turn long, role string, text string")
    assert [r.previous for r in evidence.previous_user_turn(m).orderBy("turn").collect()] == ["", "a", "a", "a", "b"]


def test_whitelist(spark):
    cells = spark.createDataFrame([(1, "d", ["e1", "e9", "e2"])], "report_id long, dimension string, evidence_ids array<string>")
    ok = spark.createDataFrame([(1, "e1"), (1, "e2")], "report_id long, evidence_id string")
    r = evidence.whitelisted(cells, ok).first()
    assert r.evidence_ids == ["e1", "e2"] and r.removed == 1


def test_merged_notes(spark):
    n = spark.createDataFrame([(1, 2, "q2", "b", ["y", "x"], False), (1, 1, "q1", "a", ["x"], False), (1, 3, "q3", None, None, True)], "report_id long, position int, question string, text string, items array<string>, failed boolean")
    r = evidence.merged_notes(n).first()
    assert (r.text, r["items"], r.gaps, r.branches, r.failed_branches) == ("a\nb", ["x", "y"], ["q3"], 3, 1)


def test_greedy_selection_skips_and_goes_on(spark):
    c = spark.createDataFrame([("d", f"c{i}", i, "x" * n, None, i) for i, n in enumerate([100, 900, 50], 1)], CHUNKS).withColumn("score", -F.col("chunk_index").cast("double")).withColumn("dimensions", F.array(F.lit("m")))
    picked = compare.select_greedily(c, "scope", "chunk_index", items=5, budget=50)
    assert rows(picked, "chunk_id", "pick") == [("c1", 1), ("c3", 2)]
    assert compare.matrix(picked, "scope").first().evidence == ["c1", "c3"]
    n = spark.range(1, 30).withColumnRenamed("id", "n")
    assert [r.n for r in compare.strided(n, "n", 2).orderBy("n").collect()] == [3, 8, 13, 18, 23]


def test_reading_order(spark):
    b = [(1, 0, 0.0, 0.0, 100.0, 5.0), (1, 1, 0.0, 10.0, 45.0, 40.0), (1, 2, 55.0, 10.0, 100.0, 40.0), (1, 3, 0.0, 45.0, 45.0, 60.0), (1, 4, 55.0, 42.0, 100.0, 60.0), (1, 5, 0.0, 70.0, 90.0, 80.0)]
    df = spark.createDataFrame(b, "page int, source_index int, x0 double, y0 double, x1 double, y1 double")
    got = C.reading_order(df, F.lit(100.0), ["page"]).orderBy("reading_order").collect()
    assert [r.source_index for r in got] == [0, 1, 3, 2, 4, 5] and got[0].two_columns


def test_layout_helpers(spark):
    raw = spark.createDataFrame([(1, 1, 1, "text", 1.0, 0.0, "infor-", 9.0, 0.0, 0.0, 5.0, 1.0), (1, 1, 2, "text", 1.0, 0.0, "mation", 9.0, 0.0, 1.0, 7.0, 2.0), (1, 2, 1, "text", 0.0, 1.0, "side", 9.0, 0.0, 0.0, 1.0, 9.0)],
                                "page_number int, source_index int, line int, kind string, dx double, dy double, text string, size double, x0 double, y0 double, x1 double, y1 double")
    k = C.kept_lines(raw).first()
    assert k.text == "information" and (k.x1, k.y1) == (7.0, 2.0) and len(k.font_sizes) == 12
    assert C.body_font(C.kept_lines(raw), "page_number").first().body_size == 9.0
    t = spark.createDataFrame([(1, "Big", 0.0, 0.0, 20.0), (1, "Title", 22.0, 0.0, 19.0), (1, "far", 300.0, 0.0, 20.0), (1, "small", 40.0, 0.0, 9.0)], "doc_id long, text string, y double, x double, size double")
    assert C.title_lines(t, "doc_id").first().title == "Big Title"
    pages = spark.createDataFrame([(1, p, f"Page {p} of 9" if p < 5 else "body") for p in range(1, 6)], "doc_id long, page int, text string")
    rep = C.repeated_margins(pages, "page", F.lit("top"))
    assert rows(rep, "signature", "pages") == [("page # of #", 4)] and C.without_margins(pages, rep, F.lit("top")).count() == 1
    w = spark.createDataFrame([("p", "title", 1, "A", "text", 0.8, False), ("p", "title", 2, "B", "llm", 0.9, False), ("p", "year", 1, "1", "x", 0.5, False), ("p", "year", 2, "2", "y", 0.4, False)], "paper_id string, field string, seq int, value string, source string, confidence double, force boolean")
    assert rows(C.metadata_winner(w), "field", "value") == [("title", "A"), ("year", "2")]
    lay = spark.createDataFrame([(1, 1, "layout"), (1, 2, " ")], "doc_id long, page int, text string")
    leg = spark.createDataFrame([(1, 1, "plain"), (1, 2, "plain"), (1, 3, "")], "doc_id long, page int, text string")
    assert rows(C.page_texts(lay, leg), "page", "extraction_method") == [(1, "layout"), (2, "legacy_fallback"), (3, "empty")]


def test_headings(spark):
    lines = spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(["Abstract", "Abstract", "text", "1. Introduction here", "References"])], "doc_id long, line int, page int, text string")
    assert [r.name for r in C.headings(lines).orderBy("line").collect()] == ["Abstract", "1. Introduction here", "References"]


def test_metrics_of_empty_answers(spark):
    o = spark.createDataFrame([(1, ["a"], []), (2, [], []), (3, ["a", "b"], ["b", "x"])], "query_id long, relevant array<string>, top array<string>").withColumn("found", F.col("top")).withColumn("should_refuse", F.size("relevant") == 0).withColumn("refused", F.size("top") == 0)
    m = evaluate.metrics(o).first()
    assert (m.cases, m.recall_at_6, m.precision_at_6, m.mrr, m.no_answer_refusal_rate, m.false_refusal_rate) == (3, 0.25, 0.25, 0.5, 1.0, 0.5)
    assert spark.range(1).select(evaluate.set_f1(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[0] == 1.0


def test_modes_and_best_config(spark):
    g = spark.createDataFrame([(2, 1.0), (1, 1.0), (3, 0.5)], "config int, quality double")
    assert evaluate.best_config(g, [F.col("quality")]).first().config == 1


def test_store(spark):
    e = spark.createDataFrame([(1, 30, "b"), (1, 10, "a"), (2, 5, "z")], "key long, at long, event_type string")
    last = spark.createDataFrame([(1, 7)], "key long, sequence long")
    assert rows(store.sequenced(e, "key", ["at"], last), "key", "sequence", "event_type") == [(1, 8, "a"), (1, 9, "b"), (2, 1, "z")]
    t = spark.createDataFrame([("t1", "pending", 0), ("t2", "done", 1)], "task_id string, status string, attempt_count int")
    assert rows(store.transition(t, {"running": ["pending"]}, F.lit("running")), "task_id", "status", "attempt_count", "changed") == [("t1", "running", 1, True), ("t2", "done", 1, False)]
    likes = spark.createDataFrame([("50%_off",), ("500 off",)], "title string")
    assert rows(likes.where(store.contains(F.col("title"), "50%_OFF")), "title") == [("50%_off",)]
    assert spark.range(1).select(store.progress(F.lit("index"))).first()[0] == 40
    secret = '{"api_key":"x","model":"m","User_Token":"y"}'
    assert spark.range(1).select(store.public_json(F.lit(secret))).first()[0] == {"model": "m"}
    up = store.upsert(last, spark.createDataFrame([(1, 9), (3, 1)], "key long, sequence long"), ["key"], "sequence")
    assert rows(up, "key", "sequence") == [(1, 9), (3, 1)]
    assert rows(store.without(up, last, ["key"]), "key") == [(3,)]
    bad = validate(likes, {"short": F.length("title") < 7, "known": F.col("title").isNotNull()}, "title")
    assert rows(bad, "key", "rule") == [("50%_off", "short"), ("500 off", "short")]


def test_sources_and_sinks(spark, tmp_path):
    state = {"document": {"metadata": {"paper_id": "p"}, "chunks": [{"chunk_id": "c1", "text": "a", "page_start": 1}, {"chunk_id": "c2", "text": "b"}]}}
    (tmp_path / "state.json").write_text(json.dumps(state))
    assert rows(readers.states(spark, str(tmp_path / "state.json")), "paper_id", "position", "chunk_id") == [("p", 0, "c1"), ("p", 1, "c2")]
    (tmp_path / "cases.jsonl").write_text('{"id": "1", "answerable": true}\n')
    assert readers.jsonl(spark, str(tmp_path / "cases.jsonl"), CASE).first().answerable
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{"id": \n')
    assert readers.jsonl_errors(spark, str(tmp_path / "bad.jsonl"), CASE).count() == 1
    by_row = {"p1": {"title": "T", "full_text": [{"section_name": "S", "paragraphs": ["x", "y"]}]}}
    by_column = {"papers": [{"paper_id": "p1", "title": "T", "full_text": {"section_name": ["S"], "paragraphs": [["x", "y"]]}}]}
    for i, shape in enumerate((by_row, by_column, by_column["papers"])):
        (tmp_path / f"b{i}.json").write_text(json.dumps(shape))
        assert rows(readers.benchmark_papers(spark, str(tmp_path / f"b{i}.json")), "paper_id", "section_name", "place", "paragraph") == [("p1", "S", 0, "x"), ("p1", "S", 1, "y")]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.7 data")
    (tmp_path / "y.txt").write_bytes(b"plain")
    got = {r.path.rsplit("/", 1)[1]: r.problems for r in readers.uploads(spark, str(tmp_path / "*.[pt][dx][ft]")).collect()}
    assert got == {"x.pdf": [], "y.txt": ["suffix", "header"]}
    v = spark.createDataFrame([("c1", 1, [3.0, 4.0]), ("c2", 2, [0.0, 2.0])], "chunk_id string, position long, vector array<float>")
    sinks.write_vector_index(v, str(tmp_path / "index"), "d", "m")
    assert readers.vector_index(spark, str(tmp_path / "index"), "d", "m", 2).count() == 2
    assert readers.vector_index(spark, str(tmp_path / "index"), "other", "m", 2) is None and readers.vector_index(spark, str(tmp_path / "none"), "d", "m", 2) is None
    (tmp_path / "r1.json").write_text('{"schema_version": "1", "x": 1}')
    (tmp_path / "r2.json").write_text('{"schema_version": "1", "deep": {"api_key": "s"}}')
    assert readers.latest_report(spark, str(tmp_path / "r?.json"), ["1"]).first().name == "r1.json"
    (tmp_path / "ask.txt").write_text("Say {word} to {name} {{literal}}")
    t = readers.templates(spark, str(tmp_path / "ask.txt")).first()
    assert t.name == "ask" and t.variables == ["word", "name"]
    new, counts = readers.legacy_import(spark.createDataFrame([("a",), ("b",), (None,)], "task_id string"), spark.createDataFrame([("a",)], "task_id string"), "task_id")
    assert rows(new, "task_id") == [("b",)] and tuple(counts.first()) == (1, 1, 1)
    s = spark.createDataFrame([(1, 2, "B & C", "two", []), (1, 1, "A", "one", ["e1"])], "report_id long, section_order int, title string, content string, evidence_ids array<string>")
    assert sinks.report_markdown(s).first().markdown == "## A\n\none\n\nEvidence: e1\n\n## B & C\n\ntwo" and "B &amp; C" in sinks.report_html(s).first().html
    sinks.replace_partitions(s.select("report_id", "title"), str(tmp_path / "ev"), "report_id")
    one = sinks.write_new(s.select("title"), None, str(tmp_path / "cas"), F.col("title"))
    assert one.count() == 2 and sinks.write_new(s.select("title"), spark.read.parquet(str(tmp_path / "cas")), str(tmp_path / "cas2"), F.col("title")).count() == 0


def test_streams_in_many_batches_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id")
    e.repartitionByRange(4, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "in"))
    s = sequences.event_stream(spark, str(tmp_path / "in"), files_per_batch=4)
    out = sequences.drained(sequences.numbered(s), spark, str(tmp_path / "out"), str(tmp_path / "state"))
    want = store.sequenced(e.withColumnRenamed("user_id", "key"), "key", ["ts", "event_id"])
    assert rows(out, "key", "event_id", "sequence") == rows(want, "key", "event_id", "sequence")
    # A restart with the same checkpoint adds nothing.
    again = sequences.drained(sequences.numbered(s), spark, str(tmp_path / "out"), str(tmp_path / "state"))
    assert again.count() == e.count()


def test_deduplicated_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50)
    e.unionByName(e).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = sequences.deduplicated(sequences.event_stream(spark, str(tmp_path / "in")))
    assert sequences.drained(s, spark, str(tmp_path / "out"), str(tmp_path / "state")).count() == 50


def test_engine(spark):
    d = spark.createDataFrame([(1, "The quick brown fox " * 100), (2, "lazy dogs sleep"), (3, None)], "doc_id long, text string")
    engine = Engine(spark)
    c = engine.chunk(d)
    q = spark.createDataFrame([(1, "brown fox"), (2, "sleepy dogs")], "query_id long, query string")
    assert engine.search(q, c, 1).where("query_id = 2").first().chunk_id == "2_page_1_chunk_1"
    assert engine.ask_context(q, c).count() >= 2 and engine.compare(c, "fox").count() == 0


def test_matrix_and_relational_cosine_agree(spark):
    c = spark.createDataFrame([("a", f"c{i}", i, t, None, i) for i, t in enumerate(["red green blue", "green green", "", "red yellow"])], CHUNKS)
    q = spark.createDataFrame([(1, "red green"), (2, "nothing here"), (3, "")], "query_id long, query string")
    wide = retrieval.hashed_topk(q, c, 10)
    narrow = retrieval.sparse_cosine(retrieval.hashed_vectors(q.withColumnRenamed("query", "text"), ["query_id"]), retrieval.hashed_vectors(c, ["chunk_id", "position"]))
    cols = ("query_id", "chunk_id", "position", F.round("score", 7))
    assert rows(wide, *cols) == rows(narrow, *cols)
