"""Runs of words against a brute-force version, on made sequences and whole documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pitchflow.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute(w):
    """All runs, by every period: maximal stretches in which words a period apart are equal, unless a smaller period holds."""
    n, out, spans = len(w), [], []
    for q in range(1, n // 4 + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            if not x and start is not None:
                length = i - start + q
                if length >= max(6, 4 * q) and not any(a <= start and start + length <= b for a, b in spans):
                    out.append((start, length, q))
                    spans.append((start, start + length))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(3)
    for k in range(300):
        n, letters = rng.choice([0, 1, 5, 6, 7, 30, 90, 200]), rng.choice([1, 2, 2, 3, 50])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            p, times = rng.randrange(1, 25), rng.uniform(1, 9)
            unit = [rng.randrange(letters) for _ in range(p)]
            at = rng.randrange(n + 1)
            w[at:at] = (unit * 10)[: int(p * times)]
        yield w
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    yield b
    yield [0] * 500
    yield ([1, 2, 3, 1, 1, 2, 3] * 40 + [9]) * 5


def test_runs_equal_brute_force(monkeypatch):
    for k, w in enumerate(sequences()):
        monkeypatch.setattr(periodic_runs, "APPEND", [1 << 16, 7, 1, 64][k % 4])
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, np.int64)).tolist()] == brute(w), w


def test_catchers_forget_what_is_past(monkeypatch):
    monkeypatch.setattr(periodic_runs, "APPEND", 50)
    rng = np.random.default_rng(0)
    w = rng.integers(0, 4, 4000)
    c = periodic_runs.Catchers(400)
    for a in range(0, 4000, 37):
        c.append(w[a : a + 37])
    assert all(len(x) <= (4 << k) + 50 + 37 for k, x in enumerate(c.names[:-1]))
    whole = periodic_runs.Catchers(400)
    whole.append(w)
    assert c.runs().tolist() == whole.runs().tolist()


def test_equal_names_of_different_words(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_mixed", lambda a, b: (a + b) % np.uint64(3))
    for w in list(sequences())[:60]:
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(w, np.int64)).tolist()] == brute(w)


def changed(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(rows):
    out = []
    for i, t in rows:
        w = changed(i, t)
        names = {}
        runs = brute([names.setdefault(x, len(names)) for x in w])
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark):
    import duckdb

    rows = [r for r in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall() if len(r[1] or "") < 12_000]
    keep = {r[0] for r in rows}
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()]
    assert len(got) == 200 and any(r[1] for r in got)
    assert sorted((r for r in got if r[0] in keep), key=repr) == digest(rows)


@pytest.mark.parametrize("batch", ["1", "2000"])
def test_odd_rows(spark, batch):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y x y x y x y x"), (5, "a a a a a"), (6, "\x1c\x85a b\x0bc d " * 9), (7, " ".join(f"w{i % 977}" for i in range(5000))), (8, "a b " * 3 + "c " + "a b " * 4)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id int, text string, runs string, n_words int")
    got = {repr((r.doc_id, r.n_words)): ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[repr((i, len(w)))] = (runs, " ".join(x for k, x in enumerate(w) if k not in gone))
    assert got == want and periodic_runs.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, times=3)
