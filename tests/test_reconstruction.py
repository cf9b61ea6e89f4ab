"""Window reconstruction against loops over cells, and masked cells that change nothing."""

import random

import numpy as np
import pyarrow as pa

from pitchflow.operators import reconstruction as R

SCHEMA = "id int, values array<double>, mask array<boolean>"
CHANNELS = ("a", "b", "c")


def made(seed=1, n=60, steps=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(2, steps * 3))
    x = rng.normal(size=(n, 2)) @ base + 0.1 * rng.normal(size=(n, steps * 3)) + 5
    mask = rng.random((n, steps)) < 0.8
    mask[0], mask[1] = True, False
    return x, mask


def frame(spark, x, mask):
    return spark.createDataFrame([(i, a.tolist(), m.tolist()) for i, (a, m) in enumerate(zip(x, mask, strict=True))], SCHEMA).repartition(3)


def brute_fit(x, mask, k, rounds, seed=3):
    n, d = x.shape
    there = np.repeat(mask, 3, axis=1)
    mean, dev = np.zeros(3), np.ones(3)
    for f in range(3):
        v = x[:, f::3][mask]
        mean[f], dev[f] = v.mean(), v.std()
    z = (x - np.tile(mean, d // 3)) / np.tile(dev, d // 3)
    w = np.random.default_rng(seed).normal(size=(d, k))
    codes = lambda i, w, z: np.linalg.solve(sum((np.outer(w[j], w[j]) for j in range(d) if there[i, j]), R.RIDGE * np.eye(k)), sum((w[j] * z[i, j] for j in range(d) if there[i, j]), np.zeros(k)))
    for _ in range(rounds):
        c = np.array([codes(i, w, z) for i in range(n)])
        w = np.array([np.linalg.solve(sum((np.outer(c[i], c[i]) for i in range(n) if there[i, j]), R.RIDGE * np.eye(k)), sum((c[i] * z[i, j] for i in range(n) if there[i, j]), np.zeros(k))) for j in range(d)])
        w = np.linalg.qr(w)[0]

    def loss(i, row):
        zz = z.copy()
        zz[i] = row
        back = w @ codes(i, w, zz)
        return sum((row[j] - back[j]) ** 2 for j in range(d) if there[i, j]) / (there[i].sum() + 1e-8)

    return z, loss, mean, dev


def test_scores_and_ablation_equal_loops(spark):
    x, mask = made()
    df = frame(spark, x, mask)
    model = R.fit_windows(df, CHANNELS, 4, 2, 5)
    z, loss, mean, dev = brute_fit(x, mask, 2, 5)
    assert np.allclose(model.mean, mean) and np.allclose(model.deviation, dev)
    want = [loss(i, z[i]) for i in range(len(x))]
    got = {r.id: r.loss for r in R.score_windows(df, model).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-6) and got[1] == 0
    back = R.window_background(df, model, 100)
    assert np.allclose(back, z[mask.all(1)].mean(0))
    for r in R.ablate_windows(df, model, back).collect():
        assert abs(r.base_value - loss(r.id, back)) < 1e-6
        for f, c in enumerate(CHANNELS):
            other = z[r.id].copy()
            other[f::3] = back[f::3]
            assert abs(r.attribution[c] - (loss(r.id, other) - want[r.id])) < 1e-6


def test_masked_cells_change_nothing(spark):
    x, mask = made(2)
    other = np.where(np.repeat(mask, 3, axis=1), x, 1e6)
    models = [R.fit_windows(frame(spark, v, mask), CHANNELS, 4, 2, 4) for v in (x, other)]
    assert np.allclose(models[0].weights, models[1].weights)
    a, b = ({r.id: r.loss for r in R.score_windows(frame(spark, v, mask), models[0]).collect()} for v in (x, other))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_components_find_the_plane(spark):
    x, mask = made(3, 200)
    model = R.fit_windows(frame(spark, x, mask), CHANNELS, 4, 2, 10)
    losses = [r.loss for r in R.score_windows(frame(spark, x, mask), model).collect()]
    odd = x[:5].copy()
    odd[:, 0::3] *= -1
    spoiled = [r.loss for r in R.score_windows(frame(spark, odd, np.ones((5, 4), bool)), model).collect()]
    assert np.median(losses) < 0.05 < min(spoiled)
    assert len(R.window_background(frame(spark, x, mask), model, 3)) == 12


def test_stacked_windows(spark):
    rng = random.Random(1)
    rows = [(p, k, rng.random(), None if (p, k) == (1, 2) else 1.0) for p in (1, None) for k in range(7)]
    got = R.stacked_windows(spark.createDataFrame(rows, "p int, at int, a double, b double"), ("a", "b"), ("p",), ("at",), 3).collect()
    assert sorted((repr(r.p), r.window, r["mask"]) for r in got) == [(repr(p), w, [w < 2 or t == 0 for t in range(3)] if (p, w) != (1, 0) else [True, True, False]) for p in (1, None) for w in range(3)]
    assert all(len(r["values"]) == 6 and all(v == 0 for t in range(3) if not r["mask"][t] for v in r["values"][2 * t : 2 * t + 2]) for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    model = R.fit_windows(empty, CHANNELS, 4, 2, 2)
    assert R.score_windows(empty, model).count() == 0 and not R.window_background(empty, model).any()


def test_pieces_bound_what_a_task_holds():
    """One large batch is worked through in pieces that view its buffers; slices and empty batches, too."""
    n = 3 * R.PIECE + 5
    batch = pa.RecordBatch.from_arrays([pa.array([[float(i)] * 4 for i in range(n)]), pa.array([[i % 2 == 0, True] for i in range(n)])], ["values", "mask"])
    got = list(R._pieces(iter([batch, batch.slice(0, 0), batch.slice(7, 2)]), 2))
    assert [len(r) for r, _, _ in got] == [R.PIECE] * 3 + [5, 2]
    assert np.concatenate([x for _, x, _ in got])[:, 0].tolist() == [*map(float, range(n)), 7.0, 8.0]
    assert got[-1][2].tolist() == [[False, True], [True, True]] and np.shares_memory(got[0][1], batch.column("values").flatten().to_numpy())


def test_ablation_of_many_windows_in_one_task(spark):
    """Pieces of one task give what single windows give, and the session's batches are bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).tolist(), [bool(i % 3), True, True, bool(i % 2)]) for i in range(R.PIECE + 40)]
    m = R.WindowModel(CHANNELS, 4, np.zeros(3), np.ones(3), np.linalg.qr(rng.normal(size=(12, 2)))[0])
    got = R.ablate_windows(spark.createDataFrame(rows, SCHEMA).coalesce(1), m, np.zeros(12)).orderBy("id").collect()
    for i in (0, R.PIECE - 1, R.PIECE, R.PIECE + 39):
        x, mask = np.array([rows[i][1]]), np.array([rows[i][2]])
        loss = m.loss(x, mask)[0]
        other = x.copy()
        other[:, 1::3] = 0
        assert abs(got[i].loss - loss) < 1e-12 and abs(got[i].attribution["b"] - (m.loss(other, mask)[0] - loss)) < 1e-12
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= R.BATCH_ROWS
