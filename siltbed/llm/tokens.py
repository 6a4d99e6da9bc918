"""Token ids of whole texts by the tokenizers library, one library call for each new word.

The pre-tokenizer of a byte-level BPE file starts a new piece at every single space between two characters that
aren't white space, so a text can be cut there and the pieces encoded apart with equal ids. Most pieces come again and
again: their ids are kept as little-endian 16- or 32-bit bytes, and a text's ids are the join of its pieces' bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltbed.llm.shared import cache

#: White space other than a space or a line feed. A few characters more than the library's own white space stand
#: here, which only means fewer cuts.
_RARE = r"\t\v\f\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿"
_ODD = re.compile(f"[{_RARE}]")
_CUT = re.compile(rf"(?<=[^ \n{_RARE}]) (?=[^ \n{_RARE}])")

#: Punctuation that may end a word; no apostrophe, which may begin a piece of letters.
_AFTER = ".,!?;:*#%$&|"

_LOADED: dict[str, "WordTokenizer"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokenizer:
    """``ids(text)`` equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    A text with the string of an added token is encoded by one library call, as such tokens split it. Memory is bounded: two generations of about ``keep`` words
    each; a word that neither holds is encoded again. New words are encoded many in one call, as a text of their own:
    the bytes that each id stands for tell where a word's ids end.
    """

    def __init__(self, path: str, keep: int = 600_000, longest: int = 48):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self._tok.get_vocab()
        self.size = len(vocabulary)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a token's letters stand for one byte each
        self._bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self._keep, self._longest = keep, longest
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._ends: dict[str, bytes] = {"": b""}
        self._starts: dict[str, bytes] = {"": b""}

    def _raw(self, piece: str) -> bytes:
        return np.array(self._tok.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()

    def _many(self, words: list[str]) -> Iterator[bytes]:
        pieces = [w if w[0] == "\n" else " " + w for w in words]
        ids = np.array(self._tok.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.int64)
        lengths = pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy()
        ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(lengths)) + 1
        raw, n = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        begin = 0
        for end in (ends * n).tolist():
            yield raw[begin:end]
            begin = end

    def _end(self, end: str) -> bytes:
        if (found := self._ends.get(end)) is None:
            found = self._raw(end)
            if len(end) <= 4:
                self._ends[end] = found
        return found

    def _start(self, start: str) -> bytes:
        if (found := self._starts.get(start)) is None:
            found = self._raw(start)
            if len(start) <= self._longest:
                if len(self._starts) > self._keep // 10:
                    self._starts.clear()
                self._starts[start] = found
        return found

    def _entries(self, words: pa.Array) -> pa.Array:
        """The ids of each of some different words; a space or, for those that have one, a line feed stands before it.

        Letters and the punctuation after them are pieces of their own to the pre-tokenizer, so they are looked up
        apart, each once for all the words that have it."""
        cores = pc.ascii_rtrim(words, characters=_AFTER)
        after = pc.subtract(pc.binary_length(words), pc.binary_length(cores))
        apart = pc.and_(pc.greater(after, 0), pc.utf8_is_alpha(pc.ascii_ltrim(cores, characters="\n")))
        coded = pc.if_else(apart, cores, words).dictionary_encode()
        # to_pylist would make a scalar for each
        ids = pa.array(self._found(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        n = np.where(apart.to_numpy(zero_copy_only=False), after.to_numpy(), 0)
        if not n.any():
            return ids
        # the last n bytes of each word
        offsets = np.concatenate([[0], np.cumsum(n)])
        last = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1 : words.offset + len(words) + 1]
        at = np.repeat(last - offsets[1:], n) + np.arange(offsets[-1])
        data = np.frombuffer(words.buffers()[2], np.uint8)[at]
        ends = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        end_ids = pa.array([*map(self._end, ends.dictionary.to_pylist())], pa.large_binary()).take(ends.indices)
        return pc.binary_join_element_wise(ids, end_ids, pa.scalar(b"", pa.large_binary()))

    def _found(self, words: list[str]) -> list[bytes]:
        """The ids of each of some different words; most are there, so only the others are encoded."""
        out = [*map(self._young.get, words)]
        missing = [i for i, ids in enumerate(out) if ids is None]
        if not missing:
            return out
        if len(self._young) > self._keep:
            self._old, self._young = self._young, {}
        young, old, new = self._young, self._old, []
        for i in missing:
            if (ids := old.get(words[i])) is None:
                new.append(i)
            else:
                out[i] = young[words[i]] = ids
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            for i, ids in zip(part, self._many([words[i] for i in part]), strict=True):
                out[i] = ids
                if len(words[i]) <= self._longest:
                    young[words[i]] = ids
        return out

    def _odd(self, text: str) -> bool:
        """Whether a text can't be cut at each single space and before each line feed."""
        return bool(
            self._added is not None and self._added.search(text)
            or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n" or _ODD.search(text)
        )

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of some texts that aren't odd: their words become codes of a dictionary, whose entries are looked up
        once each, and the codes become ids again, all in Arrow."""
        lists = pc.split_pattern(pa.array([t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.values
        starts = words.take(pa.array(offsets[:-1])).to_pylist()  # a text's start has no space before it
        later = np.ones(len(words), bool)
        later[offsets[:-1]] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        flat = self._entries(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1][offsets - np.arange(len(offsets))].tolist() if len(flat) else [0] * len(offsets)
        raw = memoryview(flat.buffers()[2]) if flat.buffers()[2] is not None else b""
        for start, begin, end in zip(starts, ends[:-1], ends[1:], strict=True):
            yield self._start(start) + raw[begin:end]

    def _odd_ids(self, text: str) -> bytes:
        if self._added is not None and self._added.search(text):
            return self._raw(text)
        first, *words = _CUT.split(text)
        different = [*dict.fromkeys(words)]
        ids = dict(zip(different, self._entries(pa.array(different, pa.large_string())).to_pylist(), strict=True))
        return self._raw(first) + b"".join(map(ids.__getitem__, words))

    def ids_bytes(self, texts: Iterable[str | None], chars: int = 8_000_000) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes; null is empty. Works on some ``chars`` characters at once."""
        held: list[str] = []
        size = 0

        def out() -> Iterator[bytes]:
            odd = [self._odd(t) for t in held]
            plain = self._by_words([t for t, x in zip(held, odd, strict=True) if not x]) if not all(odd) else iter(())
            for t, x in zip(held, odd, strict=True):
                yield self._odd_ids(t) if x else next(plain)

        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size > chars:
                yield from out()
                held.clear()
                size = 0
        yield from out()

    def id_arrays(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        tail = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        return [np.frombuffer(b + tail, self.dtype) for b in self.ids_bytes(texts)]


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each path and worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


cache("tokens", _LOADED.clear)
