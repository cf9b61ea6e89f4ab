"""Operator 6: BPE encoding and decoding by a depth-first walk over the trie of distinct words."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import split_words
from .common import SLICE_BYTES, Memo, given_back, releasing, text_slices

#: Stands for the end-of-word mark inside words; it can't occur in byte-level characters.
END = "\x00"
SCHEMA = "doc_id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: How many words and chunks a worker remembers and the bytes of a slice: where it has an executor to itself, and where
#: other stages' memory lies beside it. Neither changes a result.
ROOMY, NARROW = (200_000, 300_000, SLICE_BYTES), (60_000, 30_000, SLICE_BYTES // 4)


class TrieBPE:
    """A BPE vocabulary with word ends, and the encodings of words by prefix.

    Every prefix of a word has one last token: the token t ending there whose predecessor, the last token of what is
    left without t, can stand beside it (no merge would cross the border). Words of a batch are put in a trie and walked
    depth first; each node's last token is derived once from the states on its path and serves all words below it.
    Walking the sorted words is that depth-first order, so only the open path is held: memory follows the longest word,
    not the number of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        self.suffix = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)  # for its normalizer and pre-tokenizer on words beyond ASCII
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.ascii_words = re.compile(pre[0]["pattern"]["Regex"].replace("[\\p{L}]", "[a-z]").replace("[\\p{N}]", "[0-9]").replace("\\p{L}\\p{N}", "a-z0-9"), re.A)
        short = lambda s: s.removesuffix(self.suffix) + END if s.endswith(self.suffix) else s
        self.ids = {short(t): i for t, i in model["vocab"].items()}
        size = max(chain(model["vocab"].values(), self.added.values())) + 1
        self.token, self.length = [""] * size, [0] * size
        for t, i in model["vocab"].items():
            self.token[i], self.length[i] = t, len(short(t).removesuffix(END))
        for t, i in self.added.items():
            self.token[i] = t
        self.longest = max(len(t) for t in self.ids)
        self.rank, self.parts, self.merges = [-1] * size, [(-1, -1)] * size, {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, whole = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[whole], self.parts[whole], self.merges[x, y] = r, (x, y), r
        self.beside: dict[int, bool] = {}
        self.remember(*ROOMY[:2])

    def remember(self, words: int, chunks: int) -> None:
        """Forgets all words and chunks, and bounds how many of them it remembers from now on."""
        self.word_ids, self.chunk_memo = Memo(words), Memo(chunks)

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: going back in time, undo the later of the two borders' merges, and see
        whether the parts then side by side would have merged before that."""
        key = a << 20 | b
        if (known := self.beside.get(key)) is not None:
            return known
        limit, merges, rank, parts, ok = 1 << 60, self.merges, self.rank, self.parts, True
        while True:
            if merges.get((a, b), limit) < limit:
                ok = False
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, parts[b][0]
            else:
                break
        if len(self.beside) > 1_000_000:
            self.beside.clear()
        self.beside[key] = ok
        return ok

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct words of byte-level characters, in the trie's depth-first order."""
        ids, length, longest, fits, beside = self.ids, self.length, self.longest, self.fits, self.beside
        last: list[int] = [-1]  # last[i]: the last token of the open path's first i characters
        path = ""
        for word in sorted(words):
            n, common = len(word), 0
            for x, y in zip(path, word[:-1], strict=False):
                if x != y:
                    break
                common += 1
            del last[common + 1 :]
            for end in range(common + 1, n + 1):
                s = word[:end] + END if end == n else word
                stop = end + (end == n)
                for start in range(max(0, stop - longest), end):
                    t = ids.get(s[start:stop])
                    if t is not None and (not start or ((p := last[start]) >= 0 and (beside[p << 20 | t] if p << 20 | t in beside else fits(p, t)))):
                        break
                else:
                    raise ValueError(f"{word!r} holds a character outside the vocabulary")
                if end == n:
                    out, at = [t], start
                    while at:
                        out.append(t := last[at])
                        at -= length[t]
                    yield word, out[::-1]
                else:
                    last.append(t)
            path = word[: len(last) - 1]

    def words(self, chunk: str) -> list[str]:
        """Byte-level words of a chunk without white space and special strings."""
        if chunk.isascii() and chunk.isprintable():
            return self.ascii_words.findall(chunk.lower())
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def pieces(self, chunk: str) -> list:
        """Words, and ids of special strings."""
        if self.special and "<" in chunk and self.special.search(chunk):
            return list(chain.from_iterable([self.added[x]] if x in self.added else self.words(x) for x in self.special.split(chunk) if x))
        return self.words(chunk)

    def encode_chunks(self, chunks: list[str]) -> Iterator[tuple[str, list[int]]]:
        cut = [(c, self.pieces(c)) for c in chunks]
        missing = self.word_ids.missing({w for _, ws in cut for w in ws if isinstance(w, str)})
        known = self.word_ids.young
        known.update(self.walk(missing))
        for c, ws in cut:
            yield c, list(chain.from_iterable([w] if isinstance(w, int) else known[w] for w in ws))

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens with a space between."""
        return " ".join(map(self.token.__getitem__, ids))

    def fill(self, texts: list[str]) -> tuple[list[list[str]], dict]:
        """Chunks of each text, and for each chunk (number of ids, ids as text, tokens as text)."""
        cut = [split_words(t) for t in texts]
        missing = self.chunk_memo.missing(set(chain.from_iterable(cut)))
        young = self.chunk_memo.young
        for chunk, ids in self.encode_chunks(missing):
            young[chunk] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return cut, young


@functools.lru_cache(maxsize=2)
def trie_bpe(path: str) -> TrieBPE:
    return TrieBPE(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = trie_bpe(path)
    for part, texts in text_slices(batches, "text"):
        cut, known = bpe.fill(texts)
        ids = [[int(i) for c in chunks for i in known[c][1].split()] for chunks in cut]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = trie_bpe(path)
    for batch in batches:
        texts = [None if ids is None else bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


@releasing
def _digests(batches: Iterator[pa.RecordBatch], path: str, forget: bool = False) -> Iterator[pa.RecordBatch]:
    bpe = trie_bpe(path)
    words, chunks, size = NARROW if forget else ROOMY
    if forget:
        bpe.remember(words, chunks)
        given_back()
    for part, texts in text_slices(batches, "text", size):
        cut, known = bpe.fill(texts)
        n, ids_of, text_of = [], [], []
        for chunks in cut:
            found = [v for v in map(known.__getitem__, chunks) if v[0]]
            n.append(sum(v[0] for v in found))
            ids_of.append(hashlib.sha256(" ".join([v[1] for v in found]).encode()).hexdigest())
            text_of.append(hashlib.sha256(" ".join([v[2] for v in found]).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_of), pa.array(text_of)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    if forget:
        bpe.remember(*ROOMY[:2])


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) per row. Null text is empty and has no ids; rows with equal ids each keep a row."""
    narrow = _narrow(docs, id_col, text_col)
    return narrow.mapInArrow(partial(_encode, path=tokenizer), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of encode()'s rows; null ids give null text."""
    narrow = encoded.select("doc_id", "ids")
    return narrow.mapInArrow(partial(_decode, path=tokenizer), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text string")


def encode_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", forget: bool = False) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids' decimal text and of the decoded text, per row of docs.

    A map without any shuffle: every task encodes its own documents, and a worker keeps a bounded memo of words, so
    prefixes that many words share are worked out once (with forget, each task begins anew, keeps a small memo, and leaves
    the memory to what runs beside it and after it). Null and empty text have no tokens and the digests of "".
    Rows with equal or null ids each keep a row; an empty table gives an empty result; other columns are not read."""
    narrow = _narrow(docs, id_col, text_col)
    return narrow.mapInArrow(partial(_digests, path=tokenizer, forget=forget), SCHEMA.format(id=narrow.schema["doc_id"].dataType.simpleString()))
