"""Seeded and sequential operators against brute force; providers, files, guards and scopes on hand-made rows."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skriva.engine import Engine
from skriva.functions import providers as P
from skriva.functions import text as T
from skriva.functions import vectors as V
from skriva.operators import evaluate, evidence, review, store
from skriva.sources import pdf, readers
from skriva.streaming import sequences

TYPES = evaluate.TYPES


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def typed():
    rnd = random.Random(5)
    cases = [(i, f"p{rnd.randrange(30)}", rnd.choice(TYPES + ["extractive"])) for i in range(160)]
    chunks = {p: rnd.randint(1, 60) for _, p, _ in cases}
    return cases, chunks


def test_pilot_sample_against_brute_force(spark, typed):
    cases, chunks = typed
    quotas, cap = {"extractive": 11, "free_form": 6, "yes_no": 5, "unanswerable": 4}, 4
    left, used, want = dict(quotas), set(), []
    while sum(left.values()):
        best = None
        for paper in chunks:
            groups = {t: sorted(i for i, p, k in cases if p == paper and k == t) for t in TYPES}
            fits = [m for m in itertools.product(range(cap + 1), repeat=4) if 0 < sum(m) <= cap and all(x <= min(len(groups[t]), left[t]) for x, t in zip(m, TYPES, strict=True))]
            if paper in used or not fits:
                continue
            mix = sorted(fits, key=lambda m: (sum(m), sum(x / max(1, left[t]) for x, t in zip(m, TYPES, strict=True)), m))[-1]
            batches = -(-chunks[paper] // 8)
            offer = ((-sum(mix), batches / sum(mix), batches, sha(f"pilot:{paper}")), paper, mix, groups)
            if best is None or offer[0] < best[0]:
                best = offer
        _, paper, mix, groups = best
        used.add(paper)
        for t, x in zip(TYPES, mix, strict=True):
            want += [(paper, i, t) for i in groups[t][:x]]
            left[t] -= x
    c = spark.createDataFrame(cases, "case_id long, paper_id string, answer_type string")
    p = spark.createDataFrame(list(chunks.items()), "paper_id string, chunks int")
    assert sorted(map(tuple, evaluate.pilot_sample(c, p, quotas, cap).collect())) == sorted(want) and len(want) == sum(quotas.values())
    with pytest.raises(Exception, match="no papers left"):
        evaluate.pilot_sample(c, p, {"yes_no": 10_000}, cap).collect()


def test_balanced_folds_against_brute_force(spark, typed):
    cases, _ = typed
    papers = sorted({p for _, p, _ in cases}, key=lambda p: (-sum(q == p for _, q, _ in cases), sha(f"fold:{p}")))
    folds, want = [[] for _ in range(4)], {}
    count = lambda rows, t: sum(k == t for k in rows)
    all_ = [k for _, _, k in cases]
    for i, p in enumerate(papers):
        own = [k for _, q, k in cases if q == p]
        costs = [sum(((count(f, t) + count(own, t)) / (count(all_, t) / 4)) ** 2 for t in TYPES) + ((len(f) + len(own)) / (len(all_) / 4)) ** 2 for f in folds]
        at = i if i < 4 else min(range(4), key=lambda f: (costs[f], len(folds[f]), f))
        folds[at] += own
        want[p] = at
    c = spark.createDataFrame(cases, "case_id long, paper_id string, answer_type string")
    assert {r.paper_id: r.fold for r in evaluate.balanced_folds(c, 4).collect()} == want


def test_mock_embedding_is_seeded_by_the_text(spark):
    got = [r.e for r in spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string").select(V.mock_embed(8)("t").alias("e")).collect()]
    assert got[0] == got[2] != got[1] and got[3] is None
    for text, v in zip("ab", got[:2], strict=True):
        want = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")).standard_normal(8)
        assert v == pytest.approx(want / np.linalg.norm(want), abs=1e-6)


def test_modes_must_measure_the_same(spark):
    from skriva.plans.files import RUN, RUNS

    with pytest.raises(Exception, match="modes differ in dataset_version"):
        evaluate.compare_modes(spark.createDataFrame(RUNS, RUN)).collect()
    assert evaluate.compare_modes(spark.createDataFrame(RUNS[:2], RUN)).first().recommendation == "parallel"


def test_guards(spark):
    c = spark.createDataFrame([("c", "test", "reviewed")], "id string, split string, review_status string")
    with pytest.raises(ValueError):
        review.eligible(c, "test")
    with pytest.raises(ValueError):
        review.guarded(c, c, ["id"], "a test run")
    assert review.guarded(c, c.where("false"), ["id"], "a test run").count() == 1


def test_numbers_of_a_hot_key(spark):
    rnd = random.Random(6)
    rows = [(1 if rnd.random() < 0.7 else rnd.randrange(9), rnd.random(), i) for i in range(3000)]
    got = store.sequenced(spark.createDataFrame(rows, "key long, at double, id long").repartition(5), "key", ["at", "id"])
    seen = {}
    for k, _, i in sorted(rows):
        seen[i] = (k, sum(1 for v in seen.values() if v[0] == k) + 1)
    assert {r.id: (r.key, r.sequence) for r in got.collect()} == seen


def test_policy_retries_and_gives_up():
    class Failed(Exception):
        def __init__(self, status=None, retry_after=None):
            self.status, self.retry_after = status, retry_after

    waits, now = [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    def run(errors, **more):
        waits.clear()
        now[0] = 0.0
        todo = list(errors)
        policy = P.Policy(sleep=sleep, clock=lambda: now[0], **more)

        def call():
            if todo:
                raise todo.pop(0)
            return "ok"

        return policy.call(call)

    assert run([Failed(503), Failed(429, 2.0)]) == "ok" and 0.5 <= waits[0] <= 0.55 and waits[1] == 2.0
    for errors, more in (([Failed(400)], {}), ([Failed(500)] * 3, {}), ([Failed(429, 9.0)], {"budget": 5.0}), ([ValueError()], {})):
        with pytest.raises((Failed, ValueError)):
            run(errors, **more)
    assert run([TimeoutError()]) == "ok"


def test_providers(spark):
    d = spark.createDataFrame([(1, "the cat of"), (2, "the cat of"), (3, None)], "id long, t string")
    got = {r.id: r.embedding for r in P.embed(d, "t", P.ConceptEmbedder([["the"], ["of", "cat"]])).collect()}
    assert got == {1: [1.0, 2.0], 2: [1.0, 2.0], 3: None}
    with pytest.raises(Exception, match="unavailable"):
        P.embed(d, "t", P.BrokenProvider()).collect()
    c = spark.createDataFrame([(1, "red fox", "a", "a fox", 1.0, 1), (1, "red fox", "b", "red fox", 0.9, 2)], "query_id long, query string, chunk_id string, text string, score double, rank int")
    assert [(r.chunk_id, r.rank) for r in P.rerank(c, P.OverlapReranker()).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    broken = P.rerank(c, P.BrokenProvider()).orderBy("rank").collect()
    assert [(r.chunk_id, r.degraded_reason) for r in broken] == [("a", "ConnectionError"), ("b", "ConnectionError")]
    with pytest.raises(Exception, match="unavailable"):
        P.rerank(c, P.BrokenProvider(), fallback=False).collect()
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, [0.0, 1.0])], "vec_id long, position long, embedding array<double>")
    s = P.VectorStore()
    s.add(v)
    with pytest.raises(ValueError):
        s.add(v)
    assert len(s) == 2 and s.search(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 1).count() == 2
    s.clear()
    assert len(s) == 0 and s.search(v, 1) is None
    p = spark.createDataFrame([(1, "a"), (2, "flaky\nb"), (3, "broken")], "id long, prompt string")
    assert [(r.attempts, r.ok) for r in P.structured(p, P.EchoClient(), ["answer"], "A").orderBy("id").collect()] == [(1, True), (2, True), (2, False)]


PLAIN = (b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R]/Count 1>>endobj 3 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 200 200]/Contents 4 0 R"
         b"/Resources<</Font<</F1 5 0 R>>>>>>endobj 4 0 obj<</Length 60>>stream\nBT /F1 12 Tf 14 TL 10 100 Td (A\\(b\\)) Tj T* [(Wo) -20 (rld) -400 (again)] TJ 0 1 -1 0 5 5 Tm (side) Tj ET\nendstream endobj"
         b" 5 0 obj<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>endobj 6 0 obj<</Title (A \\101)>>endobj trailer<</Root 1 0 R/Info 6 0 R>>")


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.write_pdf(["Title line", "深度 text — ünï", "", "😀 last"] + [f"l{i}" for i in range(50)], "Der Títel"))
    (tmp_path / "b.pdf").write_bytes(PLAIN)
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.pdf").write_bytes(PLAIN.replace(b"trailer<<", b"trailer<</Encrypt 9 0 R"))
    (tmp_path / "e.txt").write_bytes(PLAIN)
    got = {(r.path[-5], r.page): r for r in pdf.scan(spark, str(tmp_path)).collect()}
    assert sorted(map(str, got)) == sorted(map(str, [("a", 1), ("a", 2), ("b", 1), ("c", None), ("d", None)]))
    assert got["a", 1].text.split("\n")[:4] == ["Title line", "深度 text — ünï", "😀 last", "l0"] and got["a", 1].title == "Der Títel" and got["a", 2].n_pages == 2
    assert got["b", 1].text == "A(b)\nWorld again" and got["b", 1].title == "A A" and len(got["b", 1].lines) == 3
    assert "header" in got["c", None].error and "encrypted" in got["d", None].error
    from skriva.operators import chunks as C

    kept = C.kept_lines(pdf.numbered_lines(pdf.scan(spark, str(tmp_path / "b.pdf"))).drop("path"))
    assert sorted(r.text for r in kept.collect()) == ["A(b)", "World again"]
    assert pdf.docx_text(pdf.write_docx(["# Head & <b>", "text"])) == "Head & <b>\ntext"


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": "x,}"}', {"a": "x,}"}), ('{"a": "```json", "b": [1,],}', {"a": "```json", "b": [1]}), ('Sure: ```json\n{"a": {"b": "}"}}\n``` ok', {"a": {"b": "}"}}), ('text {"a": 1} {"b": 2}', {"a": 1}), ("[1]", None), ("none", None), ('{"a": ', None)])
def test_json_objects(text, want):
    found = T.parsed_object(text)
    assert (json.loads(found) if found else None) == want


def test_fan_out_and_retries(spark):
    t = spark.createDataFrame([(1, 2, "b", "x"), (1, 1, "a", "y"), (1, 3, "c", "z")], "report_id long, position int, task_id string, payload string")

    def work(task, payload, attempt):
        if task == "c" or (task == "b" and attempt == 1):
            raise OSError(task)
        return payload.upper()

    done = sequences.fan_out(t, work, retries=1, parts=2)
    r = sequences.gathered(done).first()
    assert (r.notes, r.gaps, r.branches, r.failed_branches, r.attempts) == ("Y\nX", ["c"], 3, 1, 5)


def test_scopes_of_the_search(spark):
    c = spark.createDataFrame([("all", "c1", 1, "fox one", "s1", 1, 1, None), ("all", "c2", 2, "fox two", "s2", 2, 2, 3), ("all", "c3", 3, "fox three", "s2", 3, None, None)],
                              "scope string, chunk_id string, position long, text string, section string, chunk_index int, page_start int, page_end int")
    q = spark.createDataFrame([(1, "fox")], "query_id long, query string")
    ids = lambda **scope: sorted(r.chunk_id for r in Engine(spark).search(q, c, 5, **scope).collect())
    assert ids() == ["c1", "c2", "c3"] and ids(section="s2") == ["c2", "c3"] and ids(pages=(3, 9)) == ["c2"] and ids(section="", pages=(1, 1)) == ["c1"]


def test_redaction_and_whitelists_at_any_depth(spark):
    row = spark.createDataFrame([('{"a": {"Token": 1, "b": {"password": 2, "c": [1, {"secret": 3}]}}}', '[{"evidence_ids": ["x", "y"], "z": {"evidence_ids": ["y"]}}]')], "a string, b string")
    r = row.select(store.public_metadata("a").alias("a"), evidence.whitelisted_json("b", F.array(F.lit("y"))).alias("b")).first()
    assert json.loads(r.a) == {"a": {"b": {"c": [1]}}} and json.loads(r.b.payload) == [{"evidence_ids": ["y"], "z": {"evidence_ids": ["y"]}}] and r.b.removed == 1


def test_state_digest_ignores_metadata(spark):
    a, b, c = '{"document": {"x": 1, "y": [2]}, "metadata": {"t": 1}}', '{"metadata": {}, "document": {"y": [2], "x": 1}}', '{"document": {"x": 2, "y": [2]}}'
    d = [r[0] for r in spark.createDataFrame([(a,), (b,), (c,)], "v string").select(readers.content_digest(F.col("v"))).collect()]
    assert d[0] == d[1] != d[2]
