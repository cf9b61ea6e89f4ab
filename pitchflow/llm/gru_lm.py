"""Operator 3: a gated recurrent language model in numpy, trained and applied by Spark tasks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, stored

HIDDEN, VOCABULARY, CLASSES = 24, 2048, 40
#: Truncated backpropagation: so many steps a window, so many streams side by side.
STEPS, STREAMS, RATE, DAMP, WARM = 32, 128, 0.05, 1e-3, 50
#: A task with few tokens learns from fewer streams at once, so that it takes so many steps at least.
UPDATES = 300
#: A task of a round learns about so many tokens; each training document is learned from in one of so many rounds.
TASK_TOKENS, ROUNDS = 2_000_000, 2
#: Texts of about so many bytes are cut into words at once, and about so many tokens are scored side by side.
CUT_BYTES, SCORE_TOKENS, SCORE_STREAMS, SCORE_STEPS = 4 << 20, 3_000_000, 512, 64
#: Counts of at most so many frequent tokens go to every task; the others are joined by a shuffle.
FREQUENT = 1 << 18
FOLDS, HELD_OUT = 7, 2
#: Words of at most so many rows of a window are summed row by row.
FEW = 8
END = b""  # no word is empty
UNKNOWN = 0


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Slices of the batches with all words of their texts, one after the other, and the number of each text's words: what
    lies between ASCII white space, A-Z lower-cased. Null is the empty text."""
    for batch in batches:
        for a, b in slices((n or 0 for n in pc.binary_length(batch.column("text")).to_pylist()), CUT_BYTES):
            part = batch.slice(a, b - a)
            col = part.column("text").take(pa.array(np.arange(b - a)))  # copied: a cast of a slice starts at the batch's first text
            col = col.cast(pa.large_binary()).fill_null(b"")  # long offsets: no slice is too long
            lists = pc.ascii_split_whitespace(pc.ascii_lower(col.view(pa.large_string())))  # ASCII kernels go byte by byte
            words = lists.flatten().view(pa.large_binary())
            some = pc.not_equal(pc.binary_length(words), 0)
            upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
            at = lists.offsets.to_numpy()
            yield part, words.filter(some), np.diff(upto[at - at[0]])


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])

    held, rows, texts = [pa.table({"token": pa.array([], pa.large_binary()), "n": pa.array([], pa.int64())})], 0, 0
    for part, words, _ in cut(batches):
        texts += part.num_rows
        counts = words.value_counts()
        held.append(pa.table({"token": counts.field("values"), "n": counts.field("counts")}))
        rows += len(counts)
        if rows > 1_000_000:
            held = [summed()]
            rows = len(held[0])
            if rows > 500_000:
                yield from _plain(held[0])
                held, rows = [held[0].slice(0, 0)], 0
    held.append(pa.table({"token": pa.array([END], pa.large_binary()), "n": pa.array([texts], pa.int64())}))
    yield from _plain(summed())


def _plain(counts: pa.Table) -> list[pa.RecordBatch]:
    return counts.cast(pa.schema({"token": pa.binary(), "n": pa.int64()})).to_batches(max_chunksize=100_000)


class Gru:
    """Word ids are in order of frequency, 0 the unknown word in a class of its own; a class is a run of ids. The
    probability of a word is that of its class times its own within the class. Output biases start at the words'
    frequencies, so the untrained model is the unigram model of its vocabulary."""

    def __init__(self, frequency: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        v = len(frequency)
        share = np.cumsum(np.sqrt(frequency[1:]))
        bins = np.floor(share / max(share[-1], 1e-9) * (CLASSES - 1) * 0.999999).astype(int) if v > 1 else np.zeros(0, int)
        _, bins = np.unique(bins, return_inverse=True)
        self.class_of = np.concatenate([[0], bins + 1]).astype(np.int64)
        self.starts = np.concatenate([np.flatnonzero(np.diff(self.class_of, prepend=-1)), [v]])
        c = len(self.starts) - 1
        mass = np.array([frequency[a:b].sum() for a, b in zip(self.starts[:-1], self.starts[1:], strict=True)], float)
        h = HIDDEN
        self.p = {
            "x": rng.normal(0, 0.1, (v, 3 * h)), "zr": rng.normal(0, 0.2, (h, 2 * h)), "h": rng.normal(0, 0.2, (h, h)),
            "oc": np.zeros((h, c)), "bc": np.log(mass / mass.sum()), "ow": np.zeros((v, h)), "bw": np.log(frequency / mass[self.class_of]),
        }
        self.p["x"][:, :h] -= 1.0  # gates start half closed, so states live longer
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self

    def states(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(states of each step, last state) for inputs x (steps, streams); reset: a document begins there. keep gets the
        states before each step, both gates (z, r) and candidates, as arrays over the steps. Arrays of one step lie in one
        piece: parts of rows would be worked through row by row."""
        k = HIDDEN
        # sigmoid(a) is 1 / (exp(-a) + 1) and tanh(a) is 1 - 2 / (exp(2 a) + 1): signs and factors go into the weights
        zr_of, h_of, x_of = -_parts(self.p["zr"]), 2 * self.p["h"], _parts(self.p["x"])
        x_of[:2] *= -1
        x_of[2] *= 2
        inputs, out = x_of.take(x, 1), np.empty((*x.shape, k), h.dtype)
        if keep is not None:
            keep += [np.empty_like(out), np.empty((len(x), 2, x.shape[1], k), h.dtype), np.empty_like(out)]
        begins = reset.any(1)
        for t in range(len(x)):
            if begins[t]:
                h = h * ~reset[t][:, None]
            zr = np.matmul(h, zr_of, out=None if keep is None else keep[1][t])
            zr += inputs[:2, t]
            np.exp(zr, out=zr)
            np.reciprocal(np.add(zr, 1, out=zr), out=zr)
            c = (zr[1] * h) @ h_of
            c += inputs[2, t]
            np.exp(c, out=c)
            np.divide(-2, np.add(c, 1, out=c), out=c)
            c += 1
            if keep is not None:
                keep[0][t], keep[2][t] = h, c
            new = np.subtract(c, h, out=out[t])
            new *= zr[0]
            new += h
            h = new
        return out, h

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of words y after states h; with grads also the gradient of their sum, negated, by h.
        Rows are put in order of their words, so a class's rows are one slice, and logits lie one word a row."""
        p, n, k = self.p, len(y), HIDDEN
        # states lie within -1 and 1, which bounds the logits; small ones need no shift before they are raised
        small = max(float((np.abs(p["oc"]).sum(0) + np.abs(p["bc"])).max()), float((np.abs(p["ow"]).sum(1) + np.abs(p["bw"])).max())) < 60
        order = np.argsort(y.astype(np.uint16), kind="stable")  # VOCABULARY < 65536: a radix sort
        words, every = y.take(order), np.arange(n)
        rows = np.ones((n, k + 1), h.dtype)  # the last column meets the biases
        rows[:, :k] = h.take(order, 0)
        cls, edges = self.class_of[words], np.searchsorted(words, self.starts)
        logs, dh = np.empty(n, h.dtype), None if grads is None else np.empty((n, k), h.dtype)

        def softmax(weights: np.ndarray, part: slice, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            """Log probability of at[i] after row i of the part, and what the logits' gradients are."""
            e = weights @ rows[part].T
            if not small:
                e -= e.max(0)
            own = e[at, every[: len(at)]]
            total = np.exp(e, out=e).sum(0)
            if grads is not None:
                e *= 1 / total
                e[at, every[: len(at)]] -= 1
            return own - np.log(total), e

        of_classes, of_words = np.vstack([p["oc"], p["bc"]]).T, np.column_stack([p["ow"], p["bw"]])
        whole = slice(0, n)
        logs[:], e = softmax(of_classes, whole, cls)
        if grads is not None:
            by = e @ rows
            grads["oc"] += by[:, :k].T
            grads["bc"] += by[:, k]
            np.matmul(e.T, p["oc"].T, out=dh)
        for a, b, first, stop in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2 or first == stop:
                continue
            part = slice(first, stop)
            more, e = softmax(of_words[a:b], part, words[part] - a)
            logs[part] += more
            if grads is not None:
                by = e @ rows[part]
                grads["ow"][a:b] += by[:, :k]
                grads["bw"][a:b] += by[:, k]
                dh[part] += e.T @ p["ow"][a:b]
        out = np.empty_like(logs)
        out[order] = logs
        if grads is None:
            return out, None
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    def gradients(self, x: np.ndarray, y: np.ndarray, valid: np.ndarray, reset: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss over one window, back to its first step only, and the state to carry on."""
        k, keep, g = HIDDEN, [], {n: np.zeros_like(a) for n, a in self.p.items()}
        out, last = self.states(x, reset, h, keep)
        before, zr, c = keep
        z, r = zr[:, 0], zr[:, 1]
        if valid.all():
            d_out = self.log_probs(out.reshape(-1, k), y.ravel(), g)[1].reshape(out.shape)
        else:
            d_out = np.zeros_like(out)
            d_out[valid] = self.log_probs(out[valid], y[valid], g)[1]
        # what doesn't depend on the gradients of later steps, for all steps at once
        of_c, of_z, of_r, stay = z * (1 - c * c), (c - before) * z * (1 - z), before * r * (1 - r), 1 - z
        d_in = np.empty((3, *x.shape, k), out.dtype)
        dh = np.zeros_like(h)
        h_back, zr_back, begins = np.ascontiguousarray(self.p["h"].T), np.ascontiguousarray(_parts(self.p["zr"]).transpose(0, 2, 1)), reset.any(1)
        for t in range(len(x) - 1, -1, -1):
            dh += d_out[t]
            dc = np.multiply(dh, of_c[t], out=d_in[2, t])
            drh = dc @ h_back
            np.multiply(dh, of_z[t], out=d_in[0, t])
            np.multiply(drh, of_r[t], out=d_in[1, t])
            dh *= stay[t]
            drh *= r[t]
            dh += drh
            dh += d_in[0, t] @ zr_back[0]
            dh += d_in[1, t] @ zr_back[1]
            if begins[t]:
                dh *= ~reset[t][:, None]
        flat, seen = d_in.reshape(3, -1, k), before.reshape(-1, k).T
        g["zr"] += np.hstack([seen @ flat[0], seen @ flat[1]])
        g["h"] += (before * r).reshape(-1, k).T @ flat[2]
        g["x"] += _summed(flat, x.ravel(), len(g["x"]))
        n = max(1, int(valid.sum()))
        return {name: a / n for name, a in g.items()}, last

    def learn(self, documents: list[np.ndarray], begin: int) -> None:
        """One pass of truncated backpropagation with Adam steps; documents follow each other in streams."""
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        width = min(STREAMS, max(8, sum(map(len, documents)) // (STEPS * UPDATES)))
        lanes = Streams(documents, begin, width)
        h = np.zeros((lanes.width, HIDDEN), np.float32)
        total = max(1, -(-lanes.steps // STEPS))
        for step, a in enumerate(range(0, lanes.steps, STEPS), 1):
            x, y, reset, _, valid = lanes.window(a, STEPS)
            g, h = self.gradients(x, y, valid, reset, h[: x.shape[1]])
            rate = RATE * min(1, step / WARM) * (1 - (step - 1) / total)  # ends at nothing, so that the weights settle
            of_m, of_v = 0.1 / (1 - 0.9**step), math.sqrt(0.01 / (1 - 0.99**step))
            for k, d in g.items():
                # m and v are sums: the means' factors 0.1 and 0.01 are in `of_m` and `of_v`
                m[k] *= 0.9
                m[k] += d
                v[k] *= 0.99
                v[k] += np.multiply(d, d, out=d)
                np.sqrt(v[k], out=d)
                d += DAMP / of_v  # rare words' small gradients take small steps
                np.divide(m[k], d, out=d)
                d *= rate * of_m / of_v
                self.p[k] -= d

    def score(self, documents: list[np.ndarray], begin: int) -> np.ndarray:
        """Natural log probability of each document: its state is carried from window to window to its end."""
        lanes = Streams(documents, begin, SCORE_STREAMS)
        out, h = np.zeros(len(documents)), np.zeros((lanes.width, HIDDEN), np.float32)
        for a in range(0, lanes.steps, SCORE_STEPS):
            x, y, reset, owner, valid = lanes.window(a, SCORE_STEPS)
            some, h = self.states(x, reset, h[: x.shape[1]])
            logs, _ = self.log_probs(some[valid], y[valid])
            out += np.bincount(owner[valid], logs, len(documents))
        return out


def _parts(weights: np.ndarray) -> np.ndarray:
    """Blocks of HIDDEN columns, one after the other."""
    return np.ascontiguousarray(weights.reshape(len(weights), -1, HIDDEN).transpose(1, 0, 2))


def _summed(parts: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """(size, columns of all parts): the sum of each word's rows. Words of many rows are summed by products, those of few by
    adding all first rows, all second ones and so on."""
    out = np.zeros((size, parts.shape[0] * parts.shape[2]), parts.dtype)
    out[UNKNOWN] = ((words == UNKNOWN).astype(parts.dtype) @ parts).ravel()
    order = np.argsort(words.astype(np.uint16), kind="stable")
    order = order[np.count_nonzero(words == UNKNOWN) :]
    ordered = words.take(order)
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    counts, rows = np.diff(first, append=len(ordered)), np.concatenate(list(parts.take(order, 1)), 1)
    sums = rows.take(first, 0)
    few = np.flatnonzero((counts > 1) & (counts <= FEW))
    for i in range(1, FEW):
        sums[few] += rows.take(first[few] + i, 0)
        few = few[counts[few] > i + 1]
    for i in np.flatnonzero(counts > FEW).tolist():
        a = first[i]
        sums[i] = np.ones(counts[i], rows.dtype) @ rows[a : a + counts[i]]
    out[ordered.take(first)] = sums
    return out


class Streams:
    """Whole documents dealt to at most `width` streams, the longest first and each to the shortest stream. Windows of
    steps are cut on demand; streams are in order of length, so those that go on come first. A document's first input
    is `begin`."""

    def __init__(self, documents: list[np.ndarray], begin: int, width: int):
        width = max(1, min(width, len(documents)))
        heap, lanes = [(0, s) for s in range(width)], [[] for _ in range(width)]
        for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
            length, s = heapq.heappop(heap)
            lanes[s].append(i)
            heapq.heappush(heap, (length + len(documents[i]), s))
        lanes.sort(key=lambda lane: -sum(len(documents[i]) for i in lane))
        order = [i for lane in lanes for i in lane]
        docs = [documents[i] for i in order]
        sizes = np.array([len(d) for d in docs], np.int64)
        self.y = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        self.x, self.first = np.empty_like(self.y), np.zeros(len(self.y), bool)
        self.x[1:] = self.y[:-1]
        at = np.cumsum(sizes) - sizes
        self.x[at], self.first[at] = begin, True
        self.owner = np.repeat(np.array(order, np.int32), sizes)
        self.lengths = np.array([sum(len(documents[i]) for i in lane) for lane in lanes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.steps, self.width = int(self.lengths.max(initial=0)), width

    def window(self, a: int, steps: int) -> tuple[np.ndarray, ...]:
        """(input, target, first of a document, document, valid) arrays of (step, stream) of the streams longer than a."""
        live = int((self.lengths > a).sum())
        step = np.arange(a, a + min(steps, self.steps - a))[:, None]
        valid = step < self.lengths[:live]
        at = np.minimum(step, self.lengths[:live] - 1) + self.starts[:live]
        return self.x.take(at), self.y.take(at), self.first.take(at) & valid, self.owner.take(at), valid


def places(words: pa.Array, table: pa.Array) -> np.ndarray:
    """Each word's place in the table, or -1."""
    return pc.index_in(words, value_set=table).fill_null(-1).to_numpy()


def with_ends(codes: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' codes with `end` after each document, and where documents begin."""
    stops = np.cumsum(lengths + 1)
    out = np.full(stops[-1] if len(stops) else 0, end, np.int32)
    inner = np.ones(len(out), bool)
    inner[stops - 1] = False
    out[inner] = codes
    return out, stops - lengths - 1


def ids_of(words: pa.Array, lengths: np.ndarray, vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    """Word ids of documents, in the vocabulary's order from 1."""
    ids, begins = with_ends(places(words, pa.array(list(vocabulary), pa.large_binary())) + 1, lengths, vocabulary[END])
    return np.split(ids, begins[1:])


def _learn(batches: Iterator[pa.RecordBatch], vocabulary, frequency: np.ndarray, weights) -> Iterator[pa.RecordBatch]:
    words = vocabulary.value
    documents = [d for part, cut_words, lengths in cut(batches) if part.num_rows for d in ids_of(cut_words, lengths, words)]
    if not documents:
        return
    documents.sort(key=np.ndarray.tobytes)  # a shuffle's order is no order
    model = Gru(frequency).load(weights.value)
    order = np.random.default_rng(3).permutation(len(documents))
    model.learn([documents[i] for i in order], words[END])
    flat = model.flat()
    n = sum(map(len, documents))
    for a in range(0, len(flat), 20_000):
        part = flat[a : a + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part)), pa.int32()), pa.array(part.astype(np.float64) * n), pa.array([n] * len(part), pa.int64())], ["i", "w", "n"])


def train(training: DataFrame, vocabulary, frequency: np.ndarray, total: int) -> np.ndarray:
    """Weights after ROUNDS rounds that share out all rows of training: in each, tasks learn from their own documents,
    starting at the same weights, and the weights are averaged by Spark, each task's by its tokens. Rows go to rounds in
    turn as they are read, so copies of a text are spread as well. The number of tasks follows the corpus, the number
    of weights doesn't, so what reaches the driver is bounded."""
    sc = training.sparkSession.sparkContext
    weights = Gru(frequency).flat()
    tasks = max(1, math.ceil(total / (ROUNDS * TASK_TOKENS)))
    dealt = training.select("text", (F.monotonically_increasing_id() % ROUNDS).alias("turn"))
    for turn in range(ROUNDS):
        part = dealt.filter(F.col("turn") == turn).select("text").repartition(tasks)  # in turn: tasks learn about as much each
        step = part.mapInArrow(partial(_learn, vocabulary=vocabulary, frequency=frequency, weights=sc.broadcast(weights)), "i int, w double, n bigint")
        mean = step.groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toArrow()
        if len(mean):
            weights[mean["i"].to_numpy()] = mean["w"].to_numpy()
    return weights


def _score(batches: Iterator[pa.RecordBatch], vocabulary, counts, frequency: np.ndarray, weights) -> Iterator[pa.RecordBatch]:
    """Rows (uid, doc_id, held_out, n_tokens, n_unknown, n_known, known_logs, unknown_logs, model) of documents, and
    (uid, token, n) of their tokens whose counts the task hasn't got. Documents of several batches are scored side by side:
    the longest one sets how many steps there are, and a step of few streams costs nearly as much as one of many."""
    from pyspark import TaskContext

    words, count = vocabulary.value, counts.value
    model = Gru(frequency).load(weights.value)
    uid = TaskContext.get().partitionId() << 33
    common = pa.array(list(count), pa.large_binary())
    # by place in common; the last entry is for all other tokens
    logs = np.log10(np.array([*count.values(), 0], float) + 1)
    known = np.arange(len(logs)) < len(count)
    ids = np.array([*(words.get(w, UNKNOWN) for w in count), UNKNOWN], np.int32)
    inside, end = known & (ids != UNKNOWN), places(pa.array([END], pa.large_binary()), common)[0]
    known_log, unknown_log = np.where(inside, logs, 0), np.where(known & ~inside, logs, 0)
    names = ["doc_id", "held_out", "uid", "n_tokens", "n_unknown", "n_known", "known_logs", "unknown_logs", "model", "token", "n"]
    kinds = dict(zip(names[2:9], [pa.int64()] * 4 + [pa.float64()] * 3, strict=True))
    held, documents, size = [], [], 0

    def scored() -> Iterator[pa.RecordBatch]:
        scores, at = model.score(documents, words[END]) / math.log(10), 0
        for part, cols in held:
            k = part.num_rows
            cols = [pa.array(v, t) for v, t in zip((*cols, scores[at : at + k]), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *cols, pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], names)
            at += k

    for part, cut_words, lengths in cut(batches):
        k = part.num_rows
        if not k:
            continue
        codes, begins = with_ends(places(cut_words, common), lengths, end)
        ids_here = ids.take(codes)
        ids_here[begins + lengths] = words[END]
        documents += np.split(ids_here, begins[1:])
        of_each = lambda values, codes=codes, begins=begins: np.add.reduceat(values.take(codes), begins)
        numbers = uid + np.arange(k)
        cols = (numbers, lengths + 1, lengths + 1 - of_each(inside.astype(np.int64)), of_each(known.astype(np.int64)), of_each(known_log), of_each(unknown_log))
        held.append((part.select(["doc_id", "held_out"]).take(pa.array(np.arange(k))), cols))  # copied, so that the batch can go
        rare = np.flatnonzero(codes < 0)
        owner = np.searchsorted(begins, rare, "right") - 1
        # words lack the ends, one for each document before
        ends = rare == (begins + lengths).take(owner)
        coded = cut_words.take(pa.array((rare - owner)[~ends])).dictionary_encode()
        pairs, n = np.unique(owner[~ends] * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
        owner_of, code = np.divmod(pairs, max(1, len(coded.dictionary)))
        for owned, tokens, n_of in ((owner_of, coded.dictionary.take(pa.array(code)), n), (owner[ends], pa.array([END] * int(ends.sum()), pa.large_binary()), np.ones(int(ends.sum()), np.int64))):
            r = len(tokens)
            if r:
                yield pa.RecordBatch.from_arrays([pa.nulls(r, part.schema.field("doc_id").type), pa.nulls(r, pa.bool_()), pa.array(uid + owned), *(pa.nulls(r, t) for t in list(kinds.values())[1:]), tokens.cast(pa.binary()), pa.array(n_of, pa.int64())], names)
        uid += k
        size += len(ids_here)
        if size > SCORE_TOKENS:
            yield from scored()
            held, documents, size = [], [], 0
    if held:
        yield from scored()


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs.

    Tokens of all training documents (held-out ones aside) are counted; counts grow with the corpus and stay
    distributed. The model's vocabulary is the most frequent tokens; of any other token it gives the unknown word's
    probability times the token's share, by add-one counts, among all others. Frequent tokens' counts are at hand in
    every task, rarer ones are joined by token, each a document's token once. The model learns from every training
    row. Scores are log10 probabilities of whole texts.

    Null and empty texts are their end token alone. Rows with equal or null ids each keep a row (null counts as the
    empty text in the fold); without training documents all counts are 0 and the model is uniform over its end token
    and unknown words; an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    training = narrow.filter(~F.col("held_out")).select("text")
    counted = training.mapInArrow(_count, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0")
    counted = stored(counted, fresh(spark, "lm-counts"))
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    by_size = sorted(counted.groupBy(F.floor(F.log2("n")).alias("k")).count().collect(), reverse=True)  # at most 64 rows
    least, total = 1 << 62, 0
    for r in by_size:
        total += r[1]
        if total > FREQUENT:
            break
        least = 1 << r[0]
    common = {bytes(r.token): r.n for r in counted.filter(F.col("n") >= least).collect()}  # at most FREQUENT rows
    top = sorted(common, key=lambda w: (-common[w], w))[: VOCABULARY - 1]
    if END not in top:
        top = [*top[: VOCABULARY - 2], END]
    inside = sum(common.get(w, 0) for w in top)
    rest = (n - inside) + (v - sum(w in common for w in top)) + 1  # add-one mass of all tokens outside the vocabulary
    frequency = np.array([rest, *(common.get(w, 0) + 1 for w in top)], float)  # untrained, the model gives the base scores
    vocabulary = sc.broadcast({w: i for i, w in enumerate(top, 1)})
    weights = train(training, vocabulary, frequency, n)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, uid bigint, n_tokens bigint, n_unknown bigint, n_known bigint, known_logs double, unknown_logs double, model double, token binary, n bigint"
    scored = narrow.mapInArrow(partial(_score, vocabulary=vocabulary, counts=sc.broadcast(common), frequency=frequency, weights=sc.broadcast(weights)), schema)
    scored = stored(scored, fresh(spark, "lm-scores"))
    rare = scored.filter("token IS NOT NULL").select("uid", "token", "n").join(counted.filter(F.col("n") < least).select("token", F.col("n").alias("c")), "token", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_logs"))
    out = scored.filter("token IS NULL").drop("token", "n").join(rare, "uid", "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("known_logs") + F.col("unknown_logs") + logs - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("model") + F.col("unknown_logs") + logs - F.col("n_unknown") * math.log10(rest)).alias("score"),
    )
