"""The adaptive scan's neighbours against brute force: recall, exact scores, ties, repeated rows and odd vectors."""

import math
import random

import numpy as np
import pytest

from pitchflow.llm import adaptive_scan, queries

VECTORS = "vec_id bigint, embedding array<double>, score int, list string, h int, v int, copies int"


def brute(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) over rows: each row is a query and a candidate of its own."""
    real = [(i, e) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    out = []
    for j, (i, e) in enumerate(real):
        if i % every == 0:
            scored = []
            for m, (d, x) in enumerate(real):
                if m != j:
                    s = 0.0
                    for a, b in zip(e, x, strict=False):
                        s += a * b
                    scored.append((-s, d))
            out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "clash", 2, 3, 4) for i, e in rows], VECTORS)


def recall(got, want):
    """Share of each query's neighbours that are found, by score."""
    by = {}
    for q, _, _, s in got:
        by.setdefault(q, []).append(s)
    hits = sum(s >= min(by[q]) - 1e-12 and any(abs(s - x) < 1e-12 for x in by[q]) for q, _, _, s in want)
    return hits / len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_whole_tables(spark, sf):
    import duckdb

    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = {}
    for r in queries.op11_adaptive_scan(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    at = {int(i): k for k, i in enumerate(ids)}
    for q in np.flatnonzero(ids % 20 == 0):
        s = adaptive_scan.inner(x, x[q])
        found = sorted(got.pop(int(ids[q])))
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == s[at[f[1]]] and f[1] != ids[q] for f in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        s[q] = -np.inf
        true = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(true & {f[1] for f in found}), total + 20
    assert not got and hits / total >= 0.95


def test_odd_vectors_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.5]) for _ in range(6)]) for i in range(150)]
    rows += [(20, rows[20][1]), (20, rows[20][1]), (20, [0.5] * 6), (41, rows[40][1]), (200, [1.0, 2.0]), (220, [1e150] * 6), (221, [-1e150] * 6), (223, [1e-150] * 6), (240, [0.25] * 9)]
    rows += [(160, None), (180, []), (260, [0.0] * 6), (280, [float("nan")] * 6), (300, [float("inf"), 1.0]), (320, [None, 1.0]), (None, [1.0] * 6)]
    rows = [(i, e) for i, e in rows if e is None or not all(x == 0 for x in e) or i in (180, 260)]
    for probed in (1.0, 0.97):
        monkeypatch.setattr(adaptive_scan, "PROBED", probed)
        got = sorted(tuple(r) for r in adaptive_scan.nearest(frame(spark, rows)).collect())
        want = brute(rows)
        assert len(got) == len(want) and recall(got, want) >= 0.9
        if probed == 1.0:
            assert [(q, r) for q, r, _, _ in got] == [(q, r) for q, r, _, _ in want]
            assert {g[0] for g in got if g[0] in (160, 180, 260, 280, 300, 320)} == set()
    few = [(0, [1.0, 2.0]), (20, [0.5, 1.0]), (3, [1.0, 1.0])]
    assert sorted(tuple(r) for r in adaptive_scan.nearest(frame(spark, few)).collect()) == brute(few)
    assert adaptive_scan.nearest(frame(spark, [])).count() == 0
    assert adaptive_scan.nearest(frame(spark, [(20, [1.0])])).count() == 0


def test_large_list_and_many_groups(spark, monkeypatch):
    """A third of all rows is one vector; groups and blocks are small, so that lists are split and packed."""
    monkeypatch.setattr(adaptive_scan, "GROUP", 64)
    monkeypatch.setattr(adaptive_scan, "BLOCK", 10)
    monkeypatch.setattr(adaptive_scan, "SEEDS", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 40)) * rng.uniform(0.2, 3, (900, 1))
    x[rng.permutation(900)[:300]] = x[7] / 2
    rows = [(int(i), e.tolist()) for i, e in enumerate(x)]
    got = sorted(tuple(r) for r in adaptive_scan.nearest(frame(spark, rows)).collect())
    want = brute(rows)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    hot = [g for g in got if g[3] == got[0][3]]
    assert [g[2] for g in hot] == sorted(g[2] for g in hot)


def test_scan_abandons_and_agrees():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 96)) * 1.5
    x = centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 96))
    ix = adaptive_scan.Index(96, 1.0, np.linalg.qr(rng.normal(size=(96, 96)))[0], adaptive_scan.centres_of(x[:2000], 64), adaptive_scan.share_quantiles(96, 16, 1e-3), x[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))
    lists = ix.nearest_list(x)
    g = adaptive_scan.Group(ix, lists, np.arange(8000), np.arange(8000), np.ones(8000, np.int64), x)
    asked = np.arange(0, 400, 10)
    order = np.argsort(-(adaptive_scan.units(x[asked]) @ ix.centres.T), axis=1)
    row, at, score = g.search(x[asked], asked, asked, order.tolist(), np.full(len(asked), -np.inf), 20)
    hits = 0
    for i, q in enumerate(asked):
        s = adaptive_scan.inner(x, x[q])
        mine = g.ids[at[row == i]]
        assert len(mine) == 20 and score[row == i].tolist() == s[mine].tolist()
        s[q] = -np.inf
        hits += len(set(mine.tolist()) & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.99 * 800 and g.scanned < 0.6 * g.tested


def test_quantiles_of_shares():
    rng = np.random.default_rng(3)
    u = rng.normal(size=(40_000, 64))
    part = np.cumsum(u * u, axis=1) / (u * u).sum(1, keepdims=True)
    for d, x in zip((16, 32, 48), adaptive_scan.share_quantiles(64, 16, 0.01), strict=True):
        assert abs((part[:, d - 1] > x).mean() - 0.01) < 0.004


def test_groups_of_lists(monkeypatch):
    monkeypatch.setattr(adaptive_scan, "GROUP", 10)
    first, parts, n = adaptive_scan.packed(np.array([4, 5, 3, 25, 0, 10, 1]))
    assert first.tolist() == [0, 0, 1, 2, 4, 5, 6] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1] and n == 7
