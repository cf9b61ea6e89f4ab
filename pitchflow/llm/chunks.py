"""Encoding with public tokenizers by the chunk: texts are cut where the tokenizer's own rules always cut, so that the
library sees each distinct chunk once per worker and the ids of a text are those of its chunks in a row."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memo

#: White space as the tokenizers' regular expressions know it; str.split() also cuts at \x1c-\x1f.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACE = tuple("\x1c\x1d\x1e\x1f")
#: A space that does not begin a chunk: white space follows, or nothing.
LOOSE = re.compile(r" (?=\s)| \Z")
#: The same by plain search, for texts of ASCII only.
LOOSE_ASCII = tuple(" " + c for c in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")
BEFORE_SPACE = re.compile(r"(?= \S)")
#: A chunk of letters and marks, as a key; the byte-level pattern always cuts between the two.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", ".,!?;:*$%&#|"
PLAIN = re.compile(f"({LETTERS})([{MARKS}]+)")
PLAIN_CHUNK = f"\\A{LETTERS}[{MARKS}]+\\z"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library's version: counts of another version are never reused."""
    name, _ = _library(path)
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + name.encode()).hexdigest()[:32]


def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    return f"{lib.__name__} {lib.__version__}", lib


def is_loose(text: str) -> bool:
    if text.isascii():
        return text.endswith(" ") or any(x in text for x in LOOSE_ASCII)
    return LOOSE.search(text) is not None


def split_words(text: str) -> list[str]:
    """The runs between white space, by the tokenizers' notion of it."""
    if any(c in text for c in NOT_SPACE):
        return [x for x in SPACE.split(text) if x]
    return text.split()


class Known:
    """Chunks that a worker has met and their ids, as arrays: chunk i has ids[bounds[i]:bounds[i + 1]]. Forgotten as a whole
    when they take up some LIMIT bytes, as whatever is frequent comes back with the next slice."""

    LIMIT = 14 << 20

    def __init__(self, width: int):
        self.keys, self.ids, self.bounds = pa.array([""], pa.string()), np.zeros(0, f"<u{width}"), np.zeros(2, np.int64)

    def at(self, keys: pa.Array) -> np.ndarray:
        """The number of each key, -1 if it is new."""
        return pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def append(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> int:
        """The first number of the new keys."""
        first = len(self.keys)
        self.keys = pa.concat_arrays([self.keys, keys])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype, copy=False)])
        return first

    def codes(self, words: pa.Array, encoder: ChunkEncoder) -> np.ndarray:
        """The number of each word; new ones are encoded, each once."""
        if self.keys.nbytes + self.ids.nbytes + self.bounds.nbytes > self.LIMIT:
            self.__init__(self.ids.itemsize)
        coded = words.dictionary_encode()
        at = self.at(coded.dictionary)
        new = at < 0
        if new.any():
            at[new] = self._added(coded.dictionary.filter(pa.array(new)), encoder)
        return at[coded.indices.to_numpy()]

    def _added(self, keys: pa.Array, encoder: ChunkEncoder) -> np.ndarray:
        """Numbers of new chunks, each there once. Letters and marks are cut apart by a byte-level tokenizer: each of the two
        is encoded alone, once, and their ids are joined."""
        plain = pc.match_substring_regex(keys, PLAIN_CHUNK).to_numpy(zero_copy_only=False) if encoder.mode == "byte" else np.zeros(len(keys), bool)
        whole, rest = keys.filter(pa.array(plain)), keys.filter(pa.array(~plain))
        letters, marks = pc.utf8_rtrim(whole, MARKS), pc.replace_substring_regex(whole, f"\\A{LETTERS}", " ", max_replacements=1)
        parts = pa.concat_arrays([rest, letters, marks]).dictionary_encode()
        at = self.at(parts.dictionary)
        new = at < 0
        if new.any():
            missing = parts.dictionary.filter(pa.array(new))
            done, ids, sizes = [], [], []
            for some, some_ids, bounds in encoder._encode(missing.to_numpy(zero_copy_only=False).tolist()):
                done += some
                ids.append(some_ids)
                sizes.append(np.diff(bounds))
            encoded = pa.array(done, pa.string())
            at[new] = self.append(encoded, np.concatenate(ids), np.concatenate(sizes)) + pc.index_in(missing, value_set=encoded).to_numpy()
        at = at[parts.indices.to_numpy()]
        out = np.empty(len(keys), np.int64)
        out[~plain] = at[: len(rest)]
        if len(whole):
            both = at[len(rest) :].reshape(2, -1).T.ravel()
            n = self.bounds[both + 1] - self.bounds[both]
            ids = self.ids[np.repeat(self.bounds[both] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            out[plain] = self.append(whole, ids, n.reshape(-1, 2).sum(1)) + np.arange(len(whole))
        return out


class ChunkEncoder:
    """ids of texts as the library gives them, without added special tokens; special strings in texts as it handles them.

    mode "word": white space only parts words and is dropped (a Split pre-tokenizer after a white-space normalizer);
    mode "byte": byte-level pre-tokens that start with their space; mode "whole": any other tokenizer, text by text."""

    def __init__(self, path: str, cache: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _, lib = _library(path)
        self.memo, self.specials = Memo(cache), []
        self.known: Known | None = None
        if path.endswith(".model"):
            self.mode, self.model = "whole", lib.SentencePieceProcessor(model_file=path)
            self.encode_all = lambda texts: self.model.encode(texts, num_threads=1)
            return
        self.model = lib.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)  # the same ids, without offsets
        self.encode_all = lambda texts: [e.ids for e in encode(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        first = (pre.get("pretokenizers") or [{}])[0]
        drops_space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in normal.get("normalizers", [])
        if plain and drops_space and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" not in first["pattern"]["Regex"].replace("[^\\s", ""):
            self.mode = "word"
        elif plain and not normal and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            self.mode = "byte"
            size = self.model.get_vocab_size()
            self.starts = np.zeros(size, bool)  # ids whose text starts with a space
            for token, i in self.model.get_vocab().items():
                self.starts[i] = token.startswith("Ġ")
        else:
            self.mode = "whole"

    def chunks(self, text: str) -> list[str]:
        """The text's chunks as keys: in byte mode a chunk stands without the space that begins it, and the first, which
        has none, after a space."""
        if self.mode == "word":
            return split_words(text)
        if not text:
            return []
        if self.mode == "whole" or any(s in text for s in self.specials):
            return [" " + text]
        if is_loose(text):
            first, *rest = [x for x in BEFORE_SPACE.split(text) if x]
            return [first[1:] if BEFORE_SPACE.match(first) else " " + first, *(x[1:] for x in rest)]
        out = text.split(" ")
        if out[0]:
            out[0] = " " + out[0]
            return out
        return out[1:]

    def fill(self, texts: list[str], width: int = 0) -> tuple[list[list[str]], dict]:
        """Each text's chunks, and a map with the ids of every chunk among them: how many they are, or (width > 0) the ids
        themselves as little-endian integers of so many bytes."""
        cut = [self.chunks(t) for t in texts]
        return cut, self.lookup(set(chain.from_iterable(cut)), width)

    def coded(self, column: pa.Array, texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, ends, ids, bounds) of a slice of texts (the column without nulls, and the same as a list): each text's
        chunks as codes, ends[i] being where those of text i end; the ids of code c are ids[bounds[c]:bounds[c + 1]].
        Chunks are cut and told apart by Arrow; Python sees each distinct one once."""
        if self.mode == "byte":
            easy = np.array([not is_loose(t) and not any(s in t for s in self.specials) for t in texts], bool)
        else:
            easy = np.zeros(len(texts), bool)
        hard = [self.chunks(t) for t, e in zip(texts, easy.tolist(), strict=True) if not e]
        counts = np.zeros(len(texts), np.int64)
        counts[~easy] = [len(c) for c in hard]
        keys = [pa.array(list(chain.from_iterable(hard)), pa.string())]
        if easy.any():
            cut = pc.split_pattern(column if easy.all() else column.filter(pa.array(easy)), " ")
            sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
            counts[easy] = sizes
            words = cut.flatten()
            first = np.zeros(len(words), bool)
            first[np.cumsum(sizes) - sizes] = True
            head = words.filter(pa.array(first))  # empty where the text begins with its space, else a chunk without one
            head = pc.if_else(pc.equal(head, ""), "", pc.binary_join_element_wise(" ", head, ""))
            keys += [head, words.filter(pa.array(~first))]
        flat = self._known(width).codes(pa.concat_arrays([k.cast(pa.string()) for k in keys]), self)
        n = len(keys[0])
        codes = np.empty(int(counts.sum()), np.int64)
        of_easy = np.repeat(easy, counts)
        codes[~of_easy] = flat[:n]
        if easy.any():
            some = np.empty(len(flat) - n, np.int64)
            some[first], some[~first] = flat[n : n + len(head)], flat[n + len(head) :]
            codes[of_easy] = some
        known = self._known(width)
        return codes, np.cumsum(counts), known.ids, known.bounds

    def _known(self, width: int) -> Known:
        if self.known is None or self.known.ids.itemsize != width:
            self.known = Known(width)
        return self.known

    def lookup(self, keys, width: int) -> dict:
        """A map with the ids of all these chunks: how many they are, or (width > 0) the ids as bytes."""
        missing = self.memo.missing(keys)
        young = self.memo.young
        if self.mode == "byte":
            whole = []
            for key in missing:
                if key[-1] in MARKS and (m := PLAIN.fullmatch(key)):  # letters and marks are cut apart by the tokenizer: each is looked up alone
                    whole.append((key, m[1], " " + m[2]))
            if whole:
                plain = {k for k, _, _ in whole}
                parts = {x for _, a, b in whole for x in (a, b)}
                missing = [k for k in missing if k not in plain] + [x for x in parts if x not in young and x not in plain]
                self._into(young, missing, width)
                for key, a, b in whole:
                    young[key] = young[a] + young[b]
                return young
        self._into(young, missing, width)
        return young

    def _into(self, to: dict, keys: list[str], width: int) -> None:
        for part, ids, bounds in self._encode(keys):
            if width:
                data = ids.astype(f"<u{width}").tobytes()
                at = (bounds * width).tolist()
                to.update(zip(part, map(data.__getitem__, map(slice, at, at[1:])), strict=True))
            else:
                to.update(zip(part, np.diff(bounds).tolist(), strict=True))

    def _encode(self, keys: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(keys, all their ids, bounds): many chunks in one call of the library, told apart afterwards by what must begin
        or part them; else (what holds other white space or a special string) chunk by chunk."""
        single: list[str] = []
        if self.mode == "whole":
            single = keys
        else:
            fit = keys
            if self.mode == "byte":
                fit = [k for k in keys if k[0] != " " and "\n" not in k]
                single = [k for k in keys if k[0] == " " or "\n" in k]
            for i in range(0, len(fit), 512):
                part = fit[i : i + 512]
                found = self._byte_ids(part) if self.mode == "byte" else self._word_ids(part)
                if found is None:
                    single += part
                else:
                    yield part, *found
        for i in range(0, len(single), 512):
            part = single[i : i + 512]
            texts = part if self.mode == "word" else [k[1:] if k[0] == " " else " " + k for k in part]
            ids = self.encode_all(texts)
            yield part, np.fromiter(chain.from_iterable(ids), np.uint32), np.cumsum([0, *map(len, ids)])

    def _byte_ids(self, part: list[str]):
        text = " " + " ".join(part)
        if text.count(" ") != len(part) or len(text.split()) != len(part) or any(s in text for s in self.specials):
            return None
        ids = np.asarray(self.encode_all([text])[0], np.uint32)
        at = np.flatnonzero(self.starts[ids])
        return (ids, np.append(at, len(ids))) if len(at) == len(part) and not at[0] else None

    def _word_ids(self, part: list[str]):
        if not self.specials:
            return None
        mark = self.specials[-1]
        ids = np.asarray(self.encode_all([f" {mark} ".join(part)])[0], np.uint32)
        at = np.flatnonzero(ids == self.model.token_to_id(mark))
        if len(at) != len(part) - 1:  # some chunk holds the mark itself
            return None
        keep = np.ones(len(ids), bool)
        keep[at] = False
        return ids[keep], np.concatenate([[0], at - np.arange(len(at)), [len(ids) - len(at)]])


@functools.lru_cache(maxsize=4)
def encoder(path: str, purpose: str = "") -> ChunkEncoder:
    """One per worker process, file and purpose (the cached values differ by purpose)."""
    return ChunkEncoder(path)
