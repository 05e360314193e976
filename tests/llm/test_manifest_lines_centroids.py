"""Centroid clustering, line dedup and Merkle manifests against plain versions."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from skriva.llm import centroids, linededup, merkle, queries
from skriva.llm.common import Scratch, table

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
LINE = "A line that a good many documents have, with É in it"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    points = np.array([v for _, v in kept], np.int64)
    seeds = sorted((sha(f"2:{i}"), v) for i, v in kept if i is not None)[:k]
    c = np.array([v for _, v in seeds], np.int64)
    for r in range(rounds + 1):
        d = ((points[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if r < rounds:
            c = np.array([points[a == j].sum(0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    d = d.min(1)
    return sorted(((i, int(j), int(x), int(d[a == j].sum()), int(d.sum()), sha(",".join(map(str, c[j].tolist())))) for (i, _), j, x in zip(kept, a, d)), key=str)


def vectors(kind):
    rng = np.random.default_rng(3)
    if kind == "norms":  # norms differ, so that the annulus leaves centroids out
        v = rng.normal(size=(600, 64)) * rng.uniform(0.01, 3, size=(600, 1))
    elif kind == "hot":  # a third is one vector
        v = rng.normal(size=(600, 64))
        v[::3] = v[0]
    else:  # few different integers: many ties
        v = rng.integers(-1, 2, size=(600, 64)) * (np.arange(64) < 2) / 128
    return [(i, v[i].astype(np.float32).tolist(), 0) for i in range(len(v))]


@pytest.mark.parametrize("kind", ["norms", "hot", "ties"])
def test_clusters(spark, folder, kind):
    rows = vectors(kind)
    d = folder(embeddings=rows)
    got = sorted(map(tuple, queries.QUERIES["op11_annulus_clusters"](spark, d).collect()), key=str)
    assert got == plain_clusters(rows)
    if kind == "norms":
        points, _ = centroids.clustered(centroids.usable(table(spark, d, "embeddings")), Scratch(spark, "t"))
        assert points.agg({"compared": "avg"}).first()[0] < 30


def test_clusters_odd(spark, folder):
    v = [0.5] * 64
    rows = [(1, v, 0), (1, v, 0), (1, [-0.25] * 64, 0), (None, v, 0), (2, None, 0), (3, [1.0], 0), (4, [None] * 64, 0), (5, [float("inf")] * 64, 0)]
    got = sorted(map(tuple, queries.QUERIES["op11_annulus_clusters"](spark, folder(embeddings=rows)).collect()), key=str)
    assert got == plain_clusters(rows) and len(got) == 4
    # Out of range: the components saturate, the distance still fits.
    far = queries.QUERIES["op11_annulus_clusters"](spark, folder(embeddings=[(None, [3e38] * 64, 0), (1, [-3e38] * 64, 0)])).collect()
    assert {r.vec_id: (r.cluster, r.distance, r.inertia) for r in far} == {1: (0, 1 << 60, 1 << 61), None: (0, 1 << 60, 1 << 61)}


@pytest.mark.parametrize("known", [False, True])
def test_nearest_is_exact(known):
    rng = np.random.default_rng(1)
    for _ in range(200):
        k = int(rng.integers(1, 12))
        c, p = rng.integers(-3, 4, size=(k, 3)), rng.integers(-4, 5, size=(50, 3))
        d = ((p[:, None] - c[None]) ** 2).sum(2)
        cluster, distance, compared = centroids.nearest(p, rng.integers(0, k, 50) if known else None, c)
        assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all() and (compared <= k).all()


def plain_lines(rows):
    keys = lambda t: [x.strip(" \t\n\v\f\r").translate(ASCII_LOWER) for x in (t or "").split("\n")]
    where = {}
    for i, t, *_ in rows:
        for k in keys(t):
            where.setdefault(k, set()).add(i)
    last = {k: max((i for i in w if i is not None), default=None) for k, w in where.items() if len(k) >= 40 and len(w) >= 5}
    out = []
    for i, t, *_ in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if k not in last or last[k] == i]
        n = (t or "").count("\n") + 1
        out.append((i, n, n - len(kept), sha("\n".join(kept)), "\n".join(kept)))
    return out


def line_rows():
    rows = [(i, f"own {i}\n  {LINE.upper() if i % 2 else LINE}\t\r\n\nshort", "en", "a") for i in range(60)]
    rows += [(70 + i, "x" * 39 + "\n" + "y" * 40 + f"\n{i}", "en", "a") for i in range(5)]  # 39 stays, 40 goes
    rows += [(80 + i, "é" * 39 + "\n" + "É" * 40, "en", "a") for i in range(5)] + [(90, "é" * 40, "en", "a")]  # code points; only A-Z are folded
    rows += [(100, "four documents have this line, and it stays in all of them", "en", "a")] * 3 + [(101 + i, "four documents have this line, and it stays in all of them", "en", "a") for i in range(3)]
    rows += [(None, LINE + "\nkept", "en", "a"), (None, "other", "en", "a"), (110, None, "en", "a"), (111, "", "en", "a"), (59, LINE + "\n" + LINE, "en", "a")]
    return rows + [(120, "\n".join([LINE, "between"] * 30_000), "en", "a"), (119, "\n".join(["between", LINE] * 20_000), "en", "a")]


def test_lines(spark, folder):
    d, rows = folder(line_rows()), line_rows()
    got = sorted(map(tuple, queries.QUERIES["op12_line_dedup"](spark, d).collect()), key=str)
    want = plain_lines(rows)
    assert got == sorted((w[:4] for w in want), key=str) and sum(w[2] for w in want) > 20_000
    docs = table(spark, d, "documents")
    out = linededup.drop_lines(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str) == sorted(((w[0], w[4]) for w in want), key=str)
    assert all(r.n_chars == len(r.text) for r in out.where("text IS NOT NULL").collect())


def test_lines_without_documents_by_shuffle(spark, folder, monkeypatch):
    """Beyond the size that may be broadcast the result is the same."""
    from skriva.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = sorted(map(tuple, queries.QUERIES["op12_line_dedup"](spark, folder(line_rows())).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((w[:4] for w in plain_lines(line_rows())), key=str)


def plain_tree(hashes):
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for x, w in enumerate(at):
            run = w // 3 * 3
            paths[x].append(("".join(level[run:w]), "".join(level[w + 1 : run + 3])))
            at[x] = w // 3
        level = [sha("".join(level[a : a + 3])) for a in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    trees = {}
    for i, t, lang, source in rows:
        n = None if t is None else len(t)
        leaf = lambda text: sha("".join(map(part, (i, source, lang, n, text))))  # noqa: E731, B023
        even = t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        trees.setdefault(source, []).append((i is not None, i or 0, leaf(t), leaf(t.replace("\n", "")) if even else leaf(t)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    sub = {s: plain_tree([x[2] for x in sorted(trees[s])]) for s in order}
    root, tops = plain_tree([sub[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (named, i, leaf, now), path in zip(sorted(trees[s]), sub[s][1]):
            for a, b in path + top:
                now = sha(a + now + b)
            out.append((i if named else None, leaf, sub[s][0], root, sha("".join(a + b for a, b in path + top)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 3, 4, 729, 730, 2500])
def test_manifest(spark, folder, n):
    """One source with n rows, beside small ones, a null one and one that sorts by bytes."""
    rows = [(i * 7 - 9, f"text {i}\nline", "en", "hot") for i in range(n)]
    if n > 3:
        rows += [(5, None, None, None), (5, "", "fr", None), (5, "", "fr", None), (None, "a\nb", "en", "ﬁ"), (-4, "a\nb", "en", "😀"), (3, "z" * 300_000 + "\n", "en", "Z")]
    got = sorted(map(tuple, queries.QUERIES["op13_merkle_manifest"](spark, folder(rows)).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_of_many_sources(spark, folder):
    rows = [(i, f"text\n{i}", "en", f"s{i % 800}") for i in range(1000)]
    got = sorted(map(tuple, queries.QUERIES["op13_merkle_manifest"](spark, folder(rows)).collect()), key=str)
    assert got == plain_manifest(rows)


def test_paths_are_given_out(spark, folder):
    """The operator's own output: the path folds to the root, and nothing is tampered with by default."""
    d = folder([(i, f"t{i}", "en", f"s{i % 3}") for i in range(50)])
    for r in merkle.checked(table(spark, d, "documents"), Scratch(spark, "t")).collect():
        h = r.leaf
        for s in r.path:
            h = sha(s.left + h + s.right)
        assert h == r.root == r.folded_root and r.verified and len(r.path) >= 4
