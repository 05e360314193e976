"""What must hold however large the tables are: no pairs in rows, deliveries of many files, texts of every length."""

import contextlib
import io
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from skriva import session
from skriva.functions import providers
from skriva.functions import text as T
from skriva.operators import postings as P
from skriva.operators import retrieval as R
from skriva.operators import scans, store
from skriva.plans import ranking, registry, reports, streams


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_store_is_searched_without_rows_of_pairs(spark):
    """F1: the best of all scores, negative ones too, the last added first among equals."""
    rnd = random.Random(3)
    rows = [(i, i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(50)]
    s = providers.VectorStore()
    for more in (0, 1000):
        s.add(spark.createDataFrame([(i + more, p, v) for i, p, v in rows], "vec_id long, position long, embedding array<float>"))
    q = spark.createDataFrame([(7, rows[0][2]), (8, [-x for x in rows[1][2]])], "query_id long, q array<float>")
    found = s.search(q, 100)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    for query, v in ((7, rows[0][2]), (8, [-x for x in rows[1][2]])):
        score = {i: round(sum(a * b for a, b in zip(unit(w), unit(v), strict=True)), 6) for i, _, w in rows}
        want = sorted(((score[i], p) for i in score for p in (i, i + 1000)), key=lambda x: (-x[0], -x[1]))
        assert [(round(r.score, 6), r.vec_id) for r in found.where(f"query_id = {query}").orderBy("rank").collect()] == want


def test_copies_in_a_store_meet_no_other_ids(spark, tmp_path):
    """more vectors than the copies' ids are apart."""
    rows = [(i, [1.0, i % 7 + 1.0]) for i in (0, 2, 20, 1_000_000, 1_000_020, 2_000_000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(f"SELECT query_id, vec_id, rank, score FROM ({reports.ORACLES['store_topk']})").fetchall()
    assert len(want) == 20 and sorted(map(tuple, reports.store_topk(spark, str(tmp_path)).select("query_id", "vec_id", "rank", "score").collect())) == sorted(want)


@pytest.mark.parametrize("n", [0, 44, 45, 46, 47, 77, 78, 79, 80, 81, 300])
def test_an_abstract_of_any_length(spark, n):
    """neither the colon nor a whole line of key words makes up for missing characters."""
    line = "\nKeywords: alpha, beta；gamma ;, "
    body = ("Words of a text " * 20)[: max(n - 1, 0)] + ("." if n else "")
    want = body if n >= 79 else (body + line) if n + len(line) >= 79 else ""
    paper = f"Abstract: {body}{line}\n1 Introduction\n"
    found = spark.createDataFrame([(paper,)], "t string").select(F.coalesce(T.abstract(F.col("t")), F.lit(""))).first()[0]
    assert found == " ".join(want.split())


@pytest.fixture
def late(spark, monkeypatch):
    """Numbered events of which a file holds five; files are finished from the last events to the first."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "5")
    rows = [(key, 100 * key + n, n) for n in range(60, 0, -1) for key in (1, 2, 3)]
    df = spark.createDataFrame(rows, "key long, event_id long, sequence long").coalesce(1)
    monkeypatch.setattr(streams, "event_sequence", lambda spark, sf_dir: df)
    yield rows, df
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_deliveries_of_files_in_any_order(spark, late):
    """F3."""
    rows, _ = late
    out = streams.stream_delivered(spark, "")
    assert sorted((r.key, r.sequence, r.event_id) for r in out.collect()) == sorted((k, n, e) for k, e, n in rows if n > k % 6)


def test_actions_of_files_in_any_order(spark, late):
    """F4."""
    _, df = late
    actions = store.ACTIONS["task"]
    named = df.select("key", F.col("sequence").alias("at"), F.element_at(F.array(*map(F.lit, actions)), (F.col("event_id") % len(actions) + 1).cast("int")).alias("action"))
    want = scans.states(scans.parted(named, "key", ["at", "action"]), "action", "pending", actions)
    out = streams.stream_states(spark, "")
    assert sorted(map(tuple, out.drop("machine").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("query", ["stream_states", "replayed_states", "event_sequence", "stream_sequence", "stream_until_terminal", "until_terminal", "stream_delivered", "appended_sequence"])
def test_actions_of_odd_events(spark, tmp_path, query):
    """events without a user go over several parts; some have no id or time, or an id below zero."""
    rnd = random.Random(5)
    rows = [(rnd.choice([i, -i, None]) if i % 3 == 0 else i, rnd.choice([i, None]), rnd.choice([None, None, 1, 2])) for i in range(400)]
    rows = [r for r in rows if r[0] is not None or rnd.random() < 0.1]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long").withColumn("ts", F.timestamp_seconds("s"))
    e.select("*", F.when(F.col("event_id") % 50 == 0, "error").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = registry.QUERIES[query](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[query]})").fetchall()
        assert len(want) > 2 and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_postings_are_not_built_for_a_scan(spark):
    """F5 to F12: a set of questions that asks for more than the index holds goes by one scan; the postings are neither written nor shuffled."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    chunks = [(rnd.choice("ab"), f"c{i}", i, " ".join(rnd.choices(words, k=40))) for i in range(300)]
    forward = R.index(spark.createDataFrame(chunks, "scope string, chunk_id string, position long, text string"))
    many = spark.createDataFrame([(i, rnd.choice("ab"), " ".join(rnd.choices(words, k=12))) for i in range(20)], "query_id long, scope string, query string")
    built = []
    make = lambda: built.append(1) or P.build(forward)
    rows = lambda df: sorted(map(tuple, R.ranked(df, 6).select("query_id", "scope", "rank", "chunk_id", "score").collect()))
    assert rows(P.best(many, forward, make, 6)) == rows(P.search(many, P.build(forward), 6, scan=False).hits) and not built
    few = many.where("query_id = 1").withColumn("query", F.lit("w1 w2"))
    assert rows(P.best(few, forward, make, 6)) == rows(P.search(few, P.build(forward), 6, scan=True).hits) and built


@pytest.mark.parametrize("name", ["evidence_ids", "bm25_scoped", "ir_metrics"])
def test_registered_rankings_build_no_postings(spark, monkeypatch, tmp_path, name):
    """F5 to F12: 200 questions over few documents."""
    for n, sf in (("documents", "sf0.001"), ("benchmark", "sf0.1")):
        (tmp_path / f"{n}.parquet").symlink_to(f"/root/testdata/{sf}/{n}.parquet")
    monkeypatch.setattr(P, "build", lambda forward: pytest.fail("postings were built"))
    monkeypatch.setattr(ranking, "_INDEXES", {})
    assert registry.QUERIES[name](spark, str(tmp_path)).count()


def test_a_ranking_leaves_texts_where_they_are(spark):
    """F9, F16: the few best chunks go to the texts."""
    for name in ("neighbor_context", "token_f1"):
        shuffled = [line for line in plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001")).splitlines() if re.search(r"SortMergeJoin.*(chunk|doc)_id", line)]
        assert not shuffled


def test_a_task_holds_no_more_of_larger_tables(spark, monkeypatch):
    """parts go with the rows, and nothing is sorted to find a section's least flag."""
    monkeypatch.setattr(session, "ROWS", 1000)
    for name in ("report_search", "checkpoint_upsert"):
        found = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert max(int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", found)) >= 6
        assert name == "checkpoint_upsert" or "SortAggregate" not in found


def test_ideograph_terms_are_those_of_the_expressions(spark):
    """F17."""
    texts = ["", "The 深度的 cat’s ﬁn-de İ ß", "的的", "a1 深 b 度度x 的深", None, "Ünï_x don't"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.token_digests("t").alias("x"), F.sha2(F.array_join(T.terms(F.col("t")), " "), 256).alias("terms"), F.when(F.col("t").isNotNull(), F.size(T.eval_tokens(F.col("t")))).alias("n")).collect()
    assert [(r.x.terms, r.x.eval_tokens) for r in got] == [(r.terms, r.n) for r in got]


def test_words_that_stand_alone(spark):
    """the word leads its pattern, so that no place is looked at for what precedes it before its first letter fits."""
    texts = ["the the,the thex xthe _the the", "de la de la dela", "keykey key token-key", "深深 und", ""]
    concepts = [["the"], ["la", "de la"], ["key", "token"], ["深"]]
    old = [re.compile("|".join(sorted((rf"(?<![a-z0-9_]){re.escape(w)}(?![a-z0-9_])" if w.isascii() else re.escape(w) for w in ws), key=len, reverse=True))) for ws in concepts]
    assert providers.ConceptEmbedder(concepts).embed_texts(texts) == [[float(len(p.findall(t))) for p in old] for t in texts]
    counted = spark.createDataFrame([(t,) for t in texts], "t string").select(providers.concept_vector(F.col("t"), concepts)).collect()
    assert [r[0] for r in counted] == [[float(sum(len(re.findall(rf"(?<![a-z0-9_]){w}(?![a-z0-9_])" if w.isascii() else w, t)) for w in ws)) for ws in concepts] for t in texts]
    assert all(providers._alone(w).startswith(re.escape(w)) for ws in concepts for w in ws)
