"""Scans by parts, exact quantiles, state machines and postings with block maxima against plain versions, with one key that holds most of the rows."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skriva.functions import text as T
from skriva.operators import postings as P
from skriva.operators import retrieval as R
from skriva.operators import scans, store

RND = random.Random(11)
ROWS = [(0 if RND.random() < 0.9 else RND.choice([1, 2, None]), i, RND.choice([None, RND.randrange(1000)])) for i in range(2000)]


@pytest.fixture(scope="module")
def parts(spark):
    df = spark.createDataFrame(RND.sample(ROWS, len(ROWS)), "key long, at long, v long")
    return scans.parted(df, "key", ["at"], 64)


def by_key():
    out = defaultdict(list)
    for k, at, v in sorted(ROWS, key=lambda r: r[1]):
        out[k].append((at, v))
    return out


def test_parts_are_bounded(parts):
    sizes = parts.rows.groupBy("__part").count().collect()
    assert max(r["count"] for r in sizes) <= 64 and len(sizes) > 20


def test_running_values(parts):
    top, before, behind, known = {}, {}, {}, {}
    for k, rows in by_key().items():
        for i, (at, _) in enumerate(rows):
            seen = [v for _, v in rows[:i] if v is not None]
            top[at], known[at] = max(seen, default=None), seen[-1] if seen else None
            before[at], behind[at] = rows[i - 1][1] if i else None, rows[i + 1][1] if i + 1 < len(rows) else None
    assert {r["at"]: r["top"] for r in scans.running_max(parts, "v", "top").collect()} == top
    assert {r["at"]: r["__before_v"] for r in scans.previous(parts, ["v"]).collect()} == before
    assert {r["at"]: r["next"] for r in scans.following(parts, "v", "next").collect()} == behind
    assert {r["at"]: r["known"] for r in scans.last_known(parts, "v", "known").collect()} == known


@pytest.mark.parametrize("machine", sorted(store.ACTIONS))
def test_states(spark, machine):
    moves = store.ACTIONS[machine]
    names = [*moves, "unknown", None]
    rows = [(0 if RND.random() < 0.9 else RND.randrange(1, 5), i, RND.choice(names)) for i in range(3000)]
    got = scans.states(scans.parted(spark.createDataFrame(rows, "key long, at long, action string"), "key", ["at"], 64), "action", "pending", moves)
    want = {}
    for key, _, action in rows:
        status, done, refused = want.get(key, ("pending", 0, 0))
        froms, to = moves.get(action, ([], None))
        want[key] = (to, done + 1, refused) if status in froms else (status, done, refused + 1)
    assert {r["key"]: (r.status, r.applied, r.refused) for r in got.collect()} == want


def interpolated(values, p):
    s = sorted(values)
    place = p * (len(s) - 1)
    low, high = math.floor(place), math.ceil(place)
    return s[low] + (s[high] - s[low]) * (place - low)


def test_quantiles(spark):
    rows = [("hot" if RND.random() < 0.9 else RND.choice(["a", None]), RND.choice([RND.gauss(0, 5), 1.0, 1.0, None])) for _ in range(5000)] + [("one", 3.5), ("none", None), ("two", 1.0), ("two", 2.0)]
    asked = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: [r[n] for n in asked] for r in scans.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", asked, 64).collect()}
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    assert set(got) == set(groups)
    assert all(got[g] == pytest.approx([interpolated(groups[g], p) for p in asked.values()]) for g in groups)
    assert scans.quantiles(spark.createDataFrame([], "v double"), [], "v", asked).collect() == []


def plain_bm25(queries, chunks, k):
    out, scopes = {}, defaultdict(list)
    for scope, ident, position, text in chunks:
        scopes[scope].append((position, ident, Counter(T.term_list(text)) if text else Counter()))
    for query, scope, text in queries:
        rows = scopes[scope]
        length = max(sum(sum(c.values()) for *_, c in rows) / len(rows), 1) if rows else 1
        scored = []
        for position, ident, c in rows:
            n = sum(c.values())
            parts = []
            for t in T.term_list(text):
                df = sum(t in x for *_, x in rows)
                if c[t]:
                    parts.append(math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * n / length)))
            if round(sum(parts), 9) > 0:
                scored.append((-round(sum(parts), 9), position, ident))
        out[query] = [(i, pytest.approx(-s, abs=1e-8)) for s, _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("lead", [1, 4])
def test_postings_find_the_best(spark, monkeypatch, lead):
    """A word in every chunk, rare words in few ranges, a scope with most of the chunks, ties, and chunks without words."""
    monkeypatch.setattr(P, "RANGE", 16)
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    text = lambda i: " ".join(["common"] * rnd.randrange(1, 4) + rnd.choices(words, k=rnd.randrange(3, 40)) + ([f"rare{i // 200}"] * 3 if i % 200 < 8 else []))
    chunks = [("big", f"b{i}", i, text(i)) for i in range(1500)] + [("small", f"s{i}", i, f"common word {i % 3}") for i in range(40)] + [("big", "empty", 5000, ""), ("big", "null", 5001, None)]
    queries = [(1, "big", "common rare3"), (2, "big", "common"), (3, "small", "common word 1"), (4, "big", "rare1 rare1 w17 w18 common"), (5, "big", "nowhere"), (6, "gone", "common"), (7, "big", "rare0 rare7"), (8, "big", "")]
    index = P.build(R.index(spark.createDataFrame(chunks, "scope string, chunk_id string, position long, text string")))
    asked = spark.createDataFrame(queries, "query_id long, scope string, query string")
    found = P.search(asked, index, 6, lead=lead, scan=False)
    got = defaultdict(list)
    for r in R.ranked(found.hits, 6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.score))
    want = {q: rows for q, rows in plain_bm25(queries, chunks, 6).items() if rows}
    assert dict(got) == want
    whole = R.ranked(P.search(asked, index, 6, scan=True).hits, 6)
    assert sorted((r.query_id, r["rank"], r.chunk_id) for r in whole.collect()) == sorted((q, i + 1, c) for q, rows in got.items() for i, (c, _) in enumerate(rows))
    read = {r.query_id: r.blocks_read / r.blocks for r in found.blocks.collect()}
    assert read[1] < 0.6 and read[7] <= 1 and max(read.values()) <= 1


def test_postings_of_nothing(spark):
    index = P.build(R.index(spark.createDataFrame([], "scope string, chunk_id string, position long, text string")))
    assert P.search(spark.createDataFrame([(1, "x")], "query_id long, query string"), index, 3).hits.collect() == []


def test_metadata_that_is_no_json(spark):
    rows = [("{bad",), ('{"a": 1, "Token": 2}',), ("[1]",), ("",), (None,), ('{"a": NaN}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(store.public_metadata(F.col("s"))).collect()]
    assert got[:5] == ["{}", '{"a":1}', "{}", "{}", None]


def test_grid_replay_is_that_of_every_point(spark):
    """The sweep against metrics of each grid point by itself: scores that do not fall with the rank, ties, cases without results or relevant chunks, unordered thresholds."""
    from skriva.operators import evaluate as E

    rnd = random.Random(9)
    scores = [(q, f"c{r}", r, rnd.choice([1.0, 2.0, 2.5, 3.0, 7.25, None])) for q in range(40) for r in range(1, rnd.randrange(2, 12))]
    cases = [(q, [f"c{rnd.randrange(1, 12)}" for _ in range(rnd.randrange(3))] if q % 5 else None) for q in range(44)]
    grid = [(i, g, t) for i, (g, t) in enumerate((g, t) for g in (2.5, 0.0, 2.4, 9.0, 3.0, 7.25) for t in (1, 3, 6))] + [(99, 2.5, 3)]
    s, c = spark.createDataFrame(scores, "query_id long, chunk_id string, rank int, score double"), spark.createDataFrame(cases, "query_id long, relevant array<string>")
    g = spark.createDataFrame(grid, "config int, min_score double, top_k int")
    got = {r.config: r.asDict() for r in E.replay(s, c, g).collect()}
    assert set(got) == {i for i, *_ in grid}
    for config, least, top_k in grid:
        lists = s.where(F.col("score") >= least).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l"))
        none = F.array().cast("array<string>")
        x = c.join(lists, "query_id", "left").select("query_id", F.coalesce("relevant", none).alias("relevant"), F.coalesce(F.transform("l", lambda r: r["chunk_id"]), none).alias("found"))
        x = x.withColumn("top", F.slice("found", 1, top_k)).withColumn("should_refuse", F.size("relevant") == 0).withColumn("refused", F.size("top") == 0)
        want = E.metrics(x).first().asDict()
        assert {k: v for k, v in got[config].items() if k in want} == pytest.approx(want, abs=2e-6)
    assert E.replay(s, c, g.limit(0)).collect() == []


def test_spans_that_overlap(spark):
    from skriva.operators import chunks as C

    rnd = random.Random(3)
    span = lambda most: (lambda a: (a, a + rnd.choice([0, 1, rnd.randrange(most)])))(rnd.randrange(9000))
    cs = [(d, i, *span(3000)) for d, n in ((1, 150), (2, 3)) for i in range(n)] + [(1, 900, 0, 9000), (1, 901, 1024, 2048)]
    bs = [(d, i, *span(400)) for d, n in ((1, 600), (2, 5), (3, 4)) for i in range(n)] + [(1, 900, 0, 20_000), (1, 901, 1024, 1024), (1, 902, 2048, 2048)]
    got = C.chunk_blocks(spark.createDataFrame(cs, "doc_id long, chunk_index int, char_start int, char_end int"), spark.createDataFrame(bs, "doc_id long, line int, char_start int, char_end int"))
    want = {(d, i): sorted({j for e, j, x, y in bs if e == d and x < b and y > a}) for d, i, a, b in cs}
    assert {(r.doc_id, r.chunk_index): r.lines for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_first_section_of_a_page(spark):
    from skriva.operators import chunks as C

    rnd = random.Random(7)
    sections = [(d, i, f"s{i}", a, a + rnd.choice([0, 0, 3, 40, 900])) for d in (1, 2) for i, a in enumerate(rnd.randrange(1000) for _ in range(60))] + [(1, 99, "all", 0, 5000), (2, 98, "none", 5, 4)]
    pages = [(d, p) for d in (1, 2, 3) for p in range(0, 1100, 3)] + [(1, 5000), (1, 5001)]
    got = C.first_section(spark.createDataFrame(pages, "doc_id long, page int"), spark.createDataFrame(sections, "doc_id long, section_index int, name string, page_start int, page_end int"))
    first = lambda d, p: min(((i, n) for e, i, n, a, b in sections if e == d and a <= p <= b), default=(0, None))[1]
    assert {(r.doc_id, r.page): r.section for r in got.collect()} == {(d, p): first(d, p) for d, p in pages}


def test_a_long_document_is_no_square(spark):
    """20,000 chunks and 200,000 lines in one document: 4 * 10**9 pairs, of which some 10**6 overlap."""
    from skriva.operators import chunks as C

    c = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), (F.col("id") * 1000).cast("int").alias("char_start"), (F.col("id") * 1000 + 1200).cast("int").alias("char_end"))
    b = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("line"), (F.col("id") * 100).cast("int").alias("char_start"), (F.col("id") * 100 + 99).cast("int").alias("char_end"))
    assert C.chunk_blocks(c, b).agg(F.sum(F.size("lines"))).first()[0] == 20_000 * 12 - 2


@pytest.mark.parametrize(("offset", "limit"), [(0, 7), (990, 20), (500, 100), (1500, 10), (999, 1)])
def test_deep_pages(spark, offset, limit):
    rnd = random.Random(1)
    rows = [(rnd.randrange(50), i) for i in range(1000)]
    order = [F.col("a").desc(), F.col("b")]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))[offset : offset + limit]
    for shallow in (0, 10_000):
        assert [tuple(r) for r in store.page(df, order, offset, limit, shallow).collect()] == want
