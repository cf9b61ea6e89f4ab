"""Operator 8: secret scans by rules, and by character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, text_slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs, as + is greedy
#: Runs of the characters that keys and identifiers are made of; the models judge those of LEAST or more characters.
LEAST, LEAST_TRAINED = 12, 4
RUN = re.compile(f"[A-Za-z0-9+/_=-]{{{LEAST},}}")
CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Class of a byte; 0 is every other byte, and the state before the first character.
CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(CHARACTERS):
    CLASS[ord(_c)] = _i + 1
K = len(CHARACTERS) + 1
#: Weight of a character's own frequency where the one before it was rarely seen.
BACK_OFF = 5.0
#: Share of an even distribution over all characters in each model: random strings of unseen alphabets keep a chance.
EVEN_RANDOM, EVEN_ORDINARY = 0.25, 0.001
#: One labelled sample in FOLDS is held back, by its hash; of those random ones so many shall be found, and of the ordinary
#: ones at most so many.
FOLDS, RECALL, FALSE_HITS = 5, 0.95, 0.001
#: A run counts as random only if its characters together are so many times likelier (in nats), at so much a character.
LEAST_SUM, LEAST_MEAN = 6.0, 0.1
#: Mean ratios are told in steps of 1 / STEPS nats.
STEPS, WIDEST = 20, 20
COUNTS = "random boolean, bigram int, n bigint"


@dataclass(frozen=True)
class Models:
    """ratio: log-likelihood ratio of each bigram, random over ordinary; per_char: the least mean ratio of a secret;
    recall, false_hits: shares of the held-back random and ordinary strings at or above it, None without any."""

    ratio: np.ndarray
    per_char: float
    recall: float | None = None
    false_hits: float | None = None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the rules: leftmost, non-overlapping per kind; what fails is passed over whole."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def bigrams(data: bytes) -> np.ndarray:
    c = CLASS[np.frombuffer(b"\0" + data, np.uint8)]
    return c[:-1] * K + c[1:]


def secret_value(text: str, start: int, kind: int, end: int) -> str:
    """What of a base span is the random string: an assignment's value, else all of it."""
    return ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]


def free_runs(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Runs of LEAST or more characters that no base span (in order of start) touches."""
    reach, at = 0, 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            yield m


def mixed(run: str) -> bool:
    """What can be a key at all: letters with digits, or capitals behind small letters, twice at least."""
    letters = any(c.isalpha() for c in run)
    return letters and (any(c.isdigit() for c in run) or sum(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False)) > 1)


def held_back(sample: bytes) -> bool:
    return zlib.crc32(sample) % FOLDS == 0


@releasing
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of both labelled samples, held-back strings aside: values of the rules' secrets, and the other runs."""
    ordinary, random = np.zeros(K * K, np.int64), np.zeros(K * K, np.int64)
    for _, texts in text_slices(batches, "text"):
        whole = []
        for text in texts:
            data = text.encode()
            base = sorted(base_spans(text))
            for span in base:
                value = secret_value(text, *span).encode()
                if not held_back(value):
                    random += np.bincount(bigrams(value), minlength=K * K)
            if held_back(data):
                continue
            out = base + [(m.start(), 3, m.end()) for m in free_runs(text, base) if mixed(m[0])]  # what may be judged has no label
            if out:
                last, parts = 0, []
                for start, _, end in sorted(out):
                    parts.append(text[last:start])
                    last = max(last, end)
                data = "\0".join([*parts, text[last:]]).encode()
            whole.append(data)
        c = CLASS[np.frombuffer(b"\0".join([b"", *whole, b""]), np.uint8)] if whole else np.zeros(1, np.int64)
        edges = np.flatnonzero(np.diff(c > 0)) + 1  # a run's beginning and its end, in turn
        begins, ends = edges[::2], edges[1::2]
        of_run = np.repeat(ends - begins >= LEAST_TRAINED, ends - begins)
        at = np.flatnonzero(c)[of_run]
        ordinary += np.bincount(c[at - 1] * K + c[at], minlength=K * K)
    for label, n in ((True, random), (False, ordinary)):
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.bool_()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["random", "bigram", "n"])


@releasing
def _held(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often held-back strings of each label have which mean ratio, in steps."""
    n = np.zeros((2, 2 * STEPS * WIDEST + 1), np.int64)

    def tell(label: int, value: bytes) -> None:
        mean = ratio[bigrams(value)].mean()
        n[label, int(min(max(math.floor(mean * STEPS), -STEPS * WIDEST), STEPS * WIDEST)) + STEPS * WIDEST] += 1

    for _, texts in text_slices(batches, "text"):
        for text in texts:
            base = sorted(base_spans(text))
            for span in base:
                value = secret_value(text, *span).encode()
                if held_back(value):
                    tell(1, value)
            if held_back(text.encode()):
                for m in free_runs(text, base):
                    if not mixed(m[0]):
                        tell(0, m[0].encode())
    for label in range(2):
        at = np.flatnonzero(n[label])
        yield pa.RecordBatch.from_arrays([pa.array([label == 1] * len(at), pa.bool_()), pa.array(at - STEPS * WIDEST, pa.int32()), pa.array(n[label][at], pa.int64())], ["random", "bigram", "n"])


def log_ratio(random: np.ndarray, ordinary: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """The log-likelihood ratio of each bigram of characters, from their counts. A character's probability after another
    backs off to its own frequency and has a share of an even one."""
    table = np.stack([ordinary, random]).reshape(2, K, K)[:, :, 1:]  # strings end where a character of class 0 follows
    single = table.sum(1, keepdims=True) + smooth
    single /= single.sum(2, keepdims=True)
    markov = (table + BACK_OFF * single) / (table.sum(2, keepdims=True) + BACK_OFF)
    even = np.array([EVEN_ORDINARY, EVEN_RANDOM])[:, None, None]
    logs = np.log((1 - even) * markov + even / (K - 1))
    return np.concatenate([np.zeros((K, 1)), logs[1] - logs[0]], 1).ravel()


def train(docs: DataFrame, text_col: str = "text") -> Models | None:
    """Models of both kinds of strings, or None where the rules find no secret to learn from.

    Labelled samples: values of the secrets that the rules find in all documents, and all other runs of the same
    characters (words and identifiers of LEAST_TRAINED or more) but those that are to be judged. One in FOLDS, by hash, is held back; the mean ratio from
    which on a run is a secret lies midway between the least that leaves no more than FALSE_HITS of the held-back ordinary
    runs (long ones that are never judged) and the highest that still finds RECALL of the held-back random strings; where
    the two overlap, at the former. Counts are added up per task, then by Spark: what
    reaches the driver is at most 2 * K * K numbers and 2 rows a step, whatever the input."""
    texts = docs.select(F.col(text_col).alias("text"))

    def summed(f, width: int, shift: int = 0) -> np.ndarray:
        out = np.zeros((2, width))
        for r in texts.mapInArrow(f, COUNTS).groupBy("random", "bigram").agg(F.sum("n").alias("n")).collect():
            out[int(r.random), r.bigram + shift] = r.n
        return out

    counts = summed(_count, K * K)
    if not counts[1].sum():
        return None
    ratio = log_ratio(counts[1], counts[0])
    held = summed(partial(_held, ratio=ratio), 2 * STEPS * WIDEST + 1, STEPS * WIDEST)
    above = held[:, ::-1].cumsum(1)[:, ::-1]  # strings of each label from a step on
    n_ordinary, n_random = above[:, 0]
    step = STEPS * WIDEST + math.ceil(LEAST_MEAN * STEPS)
    if n_ordinary:
        few = np.flatnonzero(above[0] <= FALSE_HITS * n_ordinary)
        step = max(step, int(few.min()) if len(few) else above.shape[1] - 1)
    if n_random:
        step = max(step, (step + int(np.flatnonzero(above[1] >= RECALL * n_random).max())) // 2)
    share = lambda label, n: float(above[label, step] / n) if n else None
    return Models(ratio, step / STEPS - WIDEST, share(1, n_random), share(0, n_ordinary))


def markov_spans(text: str, models: Models, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that no base span touches, mixed as keys are, which the models take for random."""
    out = []
    for m in free_runs(text, base):
        if mixed(m[0]):
            ratios = models.ratio[bigrams(m[0].encode())]
            if ratios.sum() >= LEAST_SUM and ratios.mean() >= models.per_char:
                out.append((m.start(), 3, m.end()))
    return out


def spans_of(text: str, models: Models | None) -> tuple[list, list]:
    base = sorted(base_spans(text))
    return base, sorted(base + markov_spans(text, models, base)) if models is not None else base


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@releasing
def _scan(batches: Iterator[pa.RecordBatch], models: Models | None) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "text"):
        found = [spans_of(t, models) for t in texts]
        counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(3)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array([shown(b) for b, _ in found]), pa.array([shown(s) for _, s in found])], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])


def redacted(text: str, models: Models | None, mark: str) -> str:
    end, out = 0, []
    for a, k, b in spans_of(text, models)[1]:
        if k == 0:  # the name of what is assigned may stay
            a = ASSIGN.match(text, a).start(2)
        a = max(a, end)
        if a < b:
            out += [text[end:a], mark]
            end = b
    return "".join([*out, text[end:]])


@releasing
def _redact(batches: Iterator[pa.RecordBatch], models: Models | None, mark: str) -> Iterator[pa.RecordBatch]:
    for part, texts in text_slices(batches, "text"):
        there = part.column("text").is_valid().to_pylist()
        clean = [redacted(t, models, mark) if ok else None for t, ok in zip(texts, there, strict=True)]
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(clean, part.schema.field("text").type))


def scan(docs: DataFrame, models: Models | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans per row of docs: kind:start:end of each span in order of
    start, then kind (code points, end exclusive). spans also has what the models add (trained on docs unless given): runs
    of LEAST or more characters outside base spans, letters mixed with digits or capitals, whose log-likelihood ratio per
    character is the models' per_char or more, and LEAST_SUM in all.

    Three scans: one counts bigrams to train the models, one sets the bound by held-back samples, one finds spans; no
    shuffle but that of the counts. Null and empty texts have no spans; where no document holds a base span there is no
    model and nothing is added. Rows with equal or null ids each keep a row; an empty table gives an empty result; other
    columns are not read."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, spans string"
    return narrow.mapInArrow(partial(_scan, models=models or train(docs, text_col)), schema)


def redact(docs: DataFrame, models: Models | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs (with a column text) with every secret's value replaced by mark, as scan() finds them; texts without secrets
    and null texts stay as they are, other columns and rows with equal or null ids too; an empty table stays empty."""
    return docs.mapInArrow(partial(_redact, models=models or train(docs), mark=mark), docs.schema)
