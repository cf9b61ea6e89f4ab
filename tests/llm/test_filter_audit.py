"""The filter audit against a step-by-step version, on odd rows, large sketches and heavy texts."""

import itertools
import random
import re
from collections import defaultdict

from pitchflow.llm import filter_audit
from pitchflow.llm.common import flagged, unused

DOCS = "doc_id bigint, text string, source string, part string, id bigint, h bigint, mask int, n bigint, again boolean"
LABELS = "doc_id bigint, quality int, toxic int, n bigint"


def brute(rows, labels):
    good, toxic = ({x[0] for x in labels if x[k] == 1} - {None} for k in (1, 2))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = defaultdict(list)
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs[s or ""].append((i, {f for f in fails if fails[f]}))
    out = []
    for part, ds in docs.items():
        total, found = defaultdict(int), []
        for order in itertools.permutations("ABCDE"):
            left = ds
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                total[f] += len(gone)
                fails = sum(f in x for _, x in ds)
                found.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), sum(x == {f} for _, x in ds), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f))
        out += [(*r[:-1], total[r[-1]]) for r in found]
    return sorted(out)


def documents(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "DELTA", "x#", "béta", "ÉCOLE", "a\x1cb", "c d"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([3, 199, 200, 260]))) for _ in range(25)]
    rows = [(rng.choice([None, k, k // 2]), rng.choice(base), rng.choice(["s1", "s2", "", None])) for k in range(150)]
    rows += [(200, None, "s1"), (201, "", None), (202, " \n ", "s3"), (None, "", "s3"), (5, base[0], "s1"), (5, base[0], "s1")] + [(300 + k, "hot text", "hot") for k in range(90)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3, 4, True) for r in rows], DOCS), spark.createDataFrame([(*x, 9) for x in labels], LABELS)


def result(spark, rows, labels):
    return sorted(tuple(r) for r in filter_audit.audit_filters(*frames(spark, rows, labels)).collect())


def test_audit_equals_steps(spark):
    rows, labels = documents(1)
    assert result(spark, rows, labels) == brute(rows, labels)


def test_sketch_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(filter_audit, "COUNTERS", 1)
    rows, labels = documents(2)
    assert result(spark, rows, labels) == brute(rows, labels)


def test_audit_of_empty_tables(spark):
    rows, labels = documents(3)
    assert result(spark, [], labels) == []
    assert result(spark, rows, []) == brute(rows, [])


def test_sketch_clears_only_unique_hashes(spark):
    df = spark.createDataFrame([(i,) for i in [*range(500), 3, 3, 70, 499]], "h bigint")
    for bits_total in (1, 500):
        maybe = {r.h for r in filter_audit.possible_repeats(df, bits_total).collect()}
        assert {3, 70, 499} <= maybe
    assert len(maybe) < 50
    counts = {(r.word, k): r.counts >> 2 * k & 3 for r in filter_audit.counting_bloom(df, 16).collect() for k in range(32)}
    assert set(counts.values()) <= {0, 1, 2} and sum(counts.values()) <= 2 * 504


def test_helper_columns_take_free_names(spark):
    df = spark.createDataFrame([(1, 11, 3, 5, "x"), (2, 13, 4, 6, "y")], "k bigint, word int, Bit int, held int, `a.b` string")
    clear, maybe = flagged(df, df.filter("k = 1").select("k"), "k")
    assert [tuple(r) for r in clear.union(maybe).orderBy("k").collect()] == [(1, 11, 3, 5, "x"), (2, 13, 4, 6, "y")] and maybe.columns == df.columns
    assert unused(df, "WORD") == "WORD_0" and unused(df, "free") == "free"
