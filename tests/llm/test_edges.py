"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest

import corpus_pipeline
from skriva.llm import queries
from skriva.llm.common import table

LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
PROSE = " ".join(f"alpha{i} beta{i % 7} gamma{i % 13}" for i in range(40))
ROWS = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (2, PROSE, "en", None), (3, None, "en", "a"), (4, "", None, "a"), (5, " \n\t ", "fr", "a"), (6, LONG, "en", "b"),
    (7, "one two three", "en", "b"), (None, PROSE, "en", "b"), (8, "\0  “x” 👍🏽 ﬁ", None, None), (9, PROSE + " tail.1@example.org 4111 1111 1111 1111", "en", "b"), (1, "another text under the same id", "en", "c")]
BENCH = [(1, PROSE[:200]), (1, PROSE[:200]), (2, None), (3, ""), (None, "alpha0 beta0 gamma0"), (4, "one two three")]
LABELS = [(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0), (6, 0, 1)]
PAGES = [(1, None, None), (2, "no host", ""), (2, "http://A.example.com/en/x?y#z", "<article><p>x &amp; y</p></article>"), (None, "https://example.net", "<p>unclosed <b>bold<script>if (a<b) {"), (3, "http://a.example.com/", "<" * 50), (4, "://", "<div>" * 300 + "deep")]
VECTORS = [(1, [0.5] * 64, 1), (1, [0.5] * 64, 1), (1, [-0.5] * 64, None), (None, [0.25] * 64, 0), (2, None, 1), (3, [], 1), (4, [1.0] * 63, 1), (5, [float("nan")] + [0.0] * 63, 1), (6, [float("-inf")] + [0.0] * 63, 1),
           (7, [None] + [0.0] * 63, 1), (8, [1e30] * 64, 1)]
#: Rows of result where a query does not give one per document.
SIZES = {"op8_html_wrapper": len(PAGES), "op9_url_filter": len(PAGES), "op11_annulus_clusters": 5}


@pytest.fixture(scope="module")
def odd(folder):
    return folder(ROWS, LABELS, BENCH, PAGES, VECTORS)


@pytest.fixture(scope="module")
def empty(folder):
    return folder()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd, name):
    got = queries.QUERIES[name](spark, odd).collect()
    if name not in ("op2_pack_tokens",):
        assert len(got) == SIZES.get(name, len(ROWS))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, empty, step):
    f = corpus_pipeline.STAGES[step][1]
    for where, most in ((odd, len(ROWS)), (empty, 0)):
        docs = table(spark, where, "documents")
        out = f(spark, docs, where)
        rows = out.collect()
        assert len(rows) <= most
        if step < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_defined_results(spark, odd):
    near = {(r.doc_id, r.n_shingles): r for r in queries.QUERIES["op3_minhash_neardup"](spark, odd).collect()}
    assert near[3, 0].component_id == 3 and near[3, 0].kept and near[4, 0].kept and near[5, 0].kept
    assert near[7, 1].component_id == 7  # three words: one shingle
    assert near[None, 116].component_id is None and near[None, 116].kept
    assert not near[2, 116].kept and near[2, 116].component_id == 1
    bpe = {r.doc_id: r for r in queries.QUERIES["op1_byte_bpe"](spark, odd).collect()}
    assert bpe[3].n_tokens == bpe[4].n_tokens == 0
    hit = {r.doc_id: r for r in queries.QUERIES["op6_decontaminate"](spark, odd).collect()}
    assert hit[7].n_hit == 3 and hit[7].n_items == 1 and hit[3].n_words == 0 and not hit[8].contaminated and hit[2].contaminated
    url = {(r.page_id, r.host): r for r in queries.QUERIES["op9_url_filter"](spark, odd).collect()}
    assert url[2, "a.example.com"].rule == "example.com/en/" and url[2, "a.example.com"].verdict == "block" and url[1, ""].verdict == "allow"
    text = {(r.page_id, r.url): r for r in queries.QUERIES["op8_html_wrapper"](spark, odd).collect()}
    assert text[1, None].text == "" and text[1, None].n_chars == 0 and text[4, "://"].text == "deep"
    assert text[2, "http://A.example.com/en/x?y#z"].text == "x & y"


def test_ties(spark, folder):
    """Equal texts, equal rules, equal scores: the smaller id, the longer host, block before allow, the lenient cutoff."""
    passage = " ".join(f"tie{i} word{i % 9}" for i in range(40))
    d = folder([(5, passage, "en", "a"), (3, passage, "en", "a"), (4, passage + " more", "en", "a"), (3, passage, "en", "a")], benchmark=[(2, passage), (10, passage), (1, passage[:80])])
    near = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in queries.QUERIES["op3_minhash_neardup"](spark, d).collect()}
    assert near == {(5, 76): (3, False), (3, 76): (3, True), (4, 77): (3, False)}
    cut = sorted((r.doc_id, r.n_removed) for r in queries.QUERIES["op10_repeats"](spark, d).collect())
    assert cut == [(3, 0), (3, 0), (4, len(passage)), (5, len(passage))]
    hit = {r.doc_id: r for r in queries.QUERIES["op6_decontaminate"](spark, d).collect()}
    import hashlib

    assert hit[5].n_items == 3 and hit[5].items_sha256 == hashlib.sha256(b"1,10,2").hexdigest()  # sorted as strings
    from skriva.llm import urlfilter

    rules = spark.createDataFrame([("a.b", "/cc", "allow"), ("b", "/cc/d", "block"), ("b", "/cc/d", "allow")], "host string, path string, action string")
    urls = spark.createDataFrame([(1, "http://x.a.b/cc/d", None), (2, "http://a.b/cc/", None), (3, "http://c.b/cc/d", None)], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(urls, rules).collect()} == {1: ("a.b/cc", "allow"), 2: ("a.b/cc", "allow"), 3: ("b/cc/d", "block")}


def test_clashing_columns_pass_through(spark, odd):
    """Operators that keep other columns keep those named like their own."""
    from skriva.llm import bpe, pii
    import public_tokenizers as P

    docs = table(spark, odd, "documents")
    assert pii.pseudonymise(docs, b"k").columns == docs.columns
    out = bpe.decode(bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert sorted(out.columns) == sorted(docs.columns) and {r.n_words for r in out.collect()} == {"extra"}
