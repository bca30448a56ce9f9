"""Subword ids of whole texts by a public vocabulary, with a bounded memory of chunks."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pitscore.llm.words import LOWER, text_bytes

#: Chunks and ids that a worker remembers; beyond that it starts anew.
MEMORY_CHUNKS, MEMORY_IDS = 300_000, 3_000_000
#: Longest words of the groups that are merged together; a longer word goes through the tokeniser.
LONGEST = (6, 10, 16, 32)
_NONE = 65_535

# The byte-level alphabet writes bytes that are no printable Latin-1 sign as code points from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

_PLAIN = LOWER.copy()
_PLAIN[10] = 32
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[10] = 32


def _spaced(texts: pa.StringArray) -> pa.StringArray:
    """Texts with line ends as spaces and a space before each full stop or comma that ends a word.

    The tokeniser drops white space and parts letters and digits from marks anyway, so ids stay the same;
    there are fewer distinct chunks. Special tokens are told by their case, so texts that may hold one keep theirs.
    """
    raw, off = text_bytes(texts)
    if not len(raw):
        return texts
    data = raw.tobytes()
    special = b"<|" in data
    low = (_KEEP if special else _PLAIN)[raw]
    if not special and b"\xcc" not in data and b"\xcd" not in data:
        # Capitals of Latin-1, as no mark that combines with letters occurs.
        low[1:][(low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)] += 0x20
    word = ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    word[1:] |= (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0xBF) & (low[1:] != 0x97) & (low[1:] != 0xB7)
    mark = np.zeros(len(low), bool)
    mark[1:-1] = ((low[1:-1] == 46) | (low[1:-1] == 44)) & (low[2:] == 32) & word[:-2]
    mark[np.minimum(off[:-1], len(low) - 1)] = False
    place = np.arange(len(low)) + np.cumsum(mark)
    wide = np.full(len(low) + int(mark.sum()), 32, np.uint8)
    wide[place] = low
    shift = np.append(place, len(wide))[off] - np.append(mark, False)[off]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(shift.astype(np.int32).tobytes()), pa.py_buffer(wide.tobytes()))


@functools.lru_cache(maxsize=1)
def remembered(path: str) -> Subwords:
    """The encoder of this worker process: chunks that earlier tasks have met need no tokeniser."""
    return Subwords(path)


def lettered(words: pa.StringArray) -> np.ndarray:
    """Which words are small Latin letters only, without the empty one."""
    raw, off = text_bytes(words)
    lead = raw == 0xC3
    rest = (raw >= 0x9F) & (raw <= 0xBF) & (raw != 0xB7)
    fits = (raw >= 97) & (raw <= 122)
    fits[:-1] |= lead[:-1] & rest[1:]
    fits[1:] |= lead[:-1] & rest[1:]
    wrong = np.concatenate(([0], np.cumsum(~fits)))
    return (wrong[off[1:]] == wrong[off[:-1]]) & (np.diff(off) > 0)


class Merges:
    """Byte-pair merges of many words at once: each round merges the pair of least rank, the first of equal ones, in every word."""

    def __init__(self, model: dict):
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        key = pairs[:, 0] << 16 | pairs[:, 1]
        self.rank = np.argsort(key, kind="stable")
        self.key, self.made = key[self.rank], pairs[:, 2].astype(np.uint16)
        # Bytes inside of words, then bytes that end them: their ids, and the ranks of their pairs.
        self.bytes = np.array([vocab.get(chr(_BYTES.get(b, b)) + end, 0) for end in ("", "</w>") for b in range(256)], np.uint16)
        self.first = self._ranks(np.repeat(self.bytes, 512), np.tile(self.bytes, 512)).reshape(512, 512)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 16 | right
        at = np.minimum(self.key.searchsorted(pair), len(self.key) - 1)
        return np.where(self.key[at] == pair, self.rank[at], _NONE).astype(np.uint16)

    def _group(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        most, n = int(size.max()), len(size)
        # A row for each place in the words, so every step is one over all words.
        place = np.arange(most)[:, None]
        text = raw[np.minimum(start + place, len(raw) - 1)]
        code = text + np.where(place == size - 1, np.uint16(256), np.uint16(0))
        ids, rank = self.bytes[code], np.full((most, n), _NONE, np.uint16)
        for i in range(most - 1):
            rank[i] = np.where(i + 1 < size, self.first[code[i], code[i + 1]], _NONE)
        done, length, live = np.zeros_like(ids), size.copy(), np.arange(n)
        while len(live):
            least, k = rank[0].copy(), np.zeros(len(live), np.int64)
            for i in range(1, most):
                less = rank[i] < least
                np.copyto(least, rank[i], where=less)
                k[less] = i
            go = least < _NONE
            if not go.all():
                done[:, live[~go]] = ids[:, ~go]
                live, k, least, ids, rank = live[go], k[go], least[go], ids[:, go], rank[:, go]
            if not len(live):
                break
            for i in range(most - 1):
                behind = k < i
                np.copyto(ids[i], ids[i + 1], where=behind)
                np.copyto(rank[i], rank[i + 1], where=behind)
            rank[most - 1] = _NONE
            length[live] -= 1
            each, new = np.arange(len(live)), self.made[least]
            ids[k, each] = new
            rank[k, each] = np.where(k + 1 < length[live], self._ranks(new, ids[np.minimum(k + 1, most - 1), each]), _NONE)
            some = np.flatnonzero(k > 0)
            rank[k[some] - 1, some] = self._ranks(ids[k[some] - 1, some], new[some])
        return done.T[place.T < length[:, None]], length

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words that were merged, their ids one after the other, and how many each has."""
        raw, off = text_bytes(words)
        size, fits = np.diff(off), lettered(words)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.int64))]
        for low, high in zip((0, *LONGEST), LONGEST):
            mine = np.flatnonzero(fits & (size > low) & (size <= high))
            if len(mine):
                found.append((mine, *self._group(raw, off[mine], size[mine])))
        return tuple(np.concatenate(x) for x in zip(*found))


class Subwords:
    """Encodes white-space chunks once each and gathers the ids of texts from them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            model = json.load(file)["model"]
        byte_pairs = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not (model.get("dropout") or model.get("ignore_merges"))
        self.merges = Merges(model) if byte_pairs and 0 < len(model["merges"]) < _NONE else None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(1 << 16, np.uint16)
        self.bounds = np.zeros(1 << 12, np.int64)
        self.n = 0

    def _learn(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of the chunks in memory."""
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            if self.n + len(new) > MEMORY_CHUNKS or self.bounds[self.n] > MEMORY_IDS:
                self._forget()
                new = np.arange(len(words))
            fresh = words.take(pa.array(new))
            flat, sizes = self.encoded(fresh)
            first, used = self.n, self.bounds[self.n]
            while len(self.bounds) < first + len(new) + 1:
                self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
            while len(self.flat) < used + len(flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.bounds[first + 1 : first + 1 + len(new)] = used + np.cumsum(sizes)
            self.flat[used : used + len(flat)] = flat
            at[new] = first + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.n += len(new)
        return at

    def encode(self, texts: pa.StringArray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the n+1 bounds of the texts."""
        split = pc.split_pattern(_spaced(texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        return self.join(split.flatten(), offsets - offsets[0], end)

    def join(self, chunks: pa.StringArray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as runs of chunks, ``offsets[i]:offsets[i + 1]``."""
        flat = chunks.dictionary_encode()
        known = self._learn(flat.dictionary)
        n = len(offsets) - 1
        last = offsets[1:] + np.arange(n)
        size, start = np.empty((2, len(chunks) + n), np.int32)
        real = np.ones(len(size), bool)
        real[last] = False
        if len(chunks):
            index = flat.indices.to_numpy(zero_copy_only=False)
            size[real], start[real] = np.diff(self.bounds)[known][index], self.bounds[known][index]
        size[last], start[last] = 1, 0
        cum = np.cumsum(size, dtype=np.int64)
        total = int(cum[-1]) if len(cum) else 0
        start -= (cum - size).astype(np.int32)
        source = np.repeat(start, size)
        source += np.arange(total, dtype=np.int32)
        ids = self.flat[source]
        bounds = np.concatenate(([0], cum[last]))
        ids[bounds[1:] - 1] = end
        return ids, bounds

    def encoded(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has.

        A word of small Latin letters is one pretoken as it stands, so the merges apply to it directly.
        """
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.int64))
        merged, ids, count = self.merges.encode(words) if self.merges else nothing
        sizes = np.zeros(len(words), np.int64)
        sizes[merged] = count
        left = np.ones(len(words), bool)
        left[merged] = False
        rest = np.flatnonzero(left)
        other = [e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        sizes[rest] = [len(x) for x in other]
        start = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint16)
        for of, n, values in ((merged, count, ids), (rest, sizes[rest], np.array([x for e in other for x in e], np.uint16))):
            flat[np.repeat(start[of] - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
        return flat, sizes

    def chunks(self, words: list[str]) -> list[list[int]]:
        """Ids of each of distinct words."""
        flat, sizes = self.encoded(pa.array(words, pa.string()))
        end = np.cumsum(sizes)
        return [flat[b - n : b].tolist() for b, n in zip(end, sizes)]
