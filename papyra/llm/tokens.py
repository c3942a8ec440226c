"""Token ids of whole texts: the tokenizers library behind a cache of space-separated chunks."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in the younger half of a worker's cache. When it is full it becomes the older half and the
#: former older half goes; chunks met again move back, so frequent ones stay.
CACHE_CHUNKS = 500_000
#: A chunk that is its own token in every text: it marks the ends of the chunks encoded together.
_MARK = "\x01"
#: Chunks encoded together in one call.
_TOGETHER = 4096
#: A word of Latin letters (which normalising leaves alone, but for the case) and one ending which the
#: pre-tokenizer splits off as a token of its own.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-į]+)([.,]?)")


def default_tokenizer() -> str:
    """Path of the public 49k word-level BPE vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


class ChunkEncoder:
    """ids of a text = ids of its chunks between single spaces or line feeds, one after the other.

    That holds for tokenizers which cut at white space before merging, normalise character by
    character (NFC, lower case) and drop white space, as ``word_bpe_49k.json`` does; the
    constructor refuses others. Texts in which a special token's string occurs are encoded whole.
    A chunk that is a plain word goes straight to the library's merge model.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.path = path or default_tokenizer()
        self.tokenizer = Tokenizer.from_file(self.path)
        self.model = self.tokenizer.model
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        mark = self._encode(_MARK)
        probe = self._encode(f"it's {_MARK} Ünder-way, 42. {_MARK}\n x")
        parts = [self._encode(x) for x in ("it's", _MARK, "Ünder-way,", "42.", _MARK, "x")]
        if len(mark) != 1 or probe != sum(parts, []):
            raise ValueError(f"{self.path}: the tokenizer does not cut at white space")
        self.mark = mark[0]
        self.letters = _byte_letters()
        self.ending = {x: self._pack(self._encode(x)) if x else b"" for x in ("", ".", ",")}
        self.direct = all(
            self._pack(self._encode(w + x)) == self._word(w.lower()) + self.ending[x]
            for w in ("word", "WoRDlings", "Ünter", "çãÆþįøÿ", "ñÀ", "xqzvw", "ß")
            for x in self.ending
        )
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """ids of a lower-case word of letters."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Encode plain chunks together, cut at the marks, and keep them."""
        step = self.dtype.itemsize
        for at in range(0, len(chunks), _TOGETHER):
            part = chunks[at : at + _TOGETHER]
            ids = np.array(self._encode(f" {_MARK} ".join(part)), self.dtype)
            data = ids.tobytes()
            ends = (np.flatnonzero(ids == self.mark) * step).tolist()
            if len(ends) != len(part) - 1:
                raise ValueError("a chunk holds the mark")
            for chunk, a, b in zip(part, [0, *(e + step for e in ends)], [*ends, len(data)]):
                self.cache[chunk] = data[a:b]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """ids of every text of a string column, null as of the empty text.

        Arrow cuts the column into chunks and numbers the different ones; only these are looked up, and
        numpy lays their ids out in the order of the texts.
        """
        texts = pc.fill_null(texts, "")
        for special in self.special:
            if pc.any(pc.match_substring(texts, special)).as_py():
                return self._encode_each(texts.to_pylist())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        data = self._look_up(coded.dictionary.to_pylist())
        step = self.dtype.itemsize
        pool = np.frombuffer(b"".join(data), self.dtype)
        size = np.fromiter(map(len, data), np.int64, len(data)) // step
        start = np.cumsum(size) - size
        chunk = coded.indices.to_numpy()
        sizes = size[chunk]
        ends = np.cumsum(sizes)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[chunk] - (ends - sizes), sizes)]
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def _encode_each(self, texts: list[str]) -> list[np.ndarray]:
        """A column in which a special token's string occurs: such texts are encoded whole."""
        return [
            np.array(self._encode(t), self.dtype) if any(s in t for s in self.special) else self.encode(pa.array([t]))[0]
            for t in texts
        ]

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """ids of different chunks, from the cache where they are known."""
        if len(self.cache) > CACHE_CHUNKS:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        plain: list[str] = []
        shape, word, ending = _WORD.fullmatch, self._word, self.ending
        for c in set(chunks).difference(cache):
            if (ids := older.get(c)) is not None:
                cache[c] = ids
            elif self.direct and (m := shape(c)):
                low = m[1].lower()
                ids = cache.get(low) or older.get(low)
                if ids is None:
                    ids = word(low)
                cache[low] = ids
                cache[c] = ids + ending[m[2]] if m[2] else ids
            elif not c or _MARK in c:
                cache[c] = self._pack(self._encode(c))
            else:
                plain.append(c)
        self._learn(plain)
        return list(map(cache.__getitem__, chunks))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str | None = None) -> ChunkEncoder:
    """The encoder of this worker process, made once per vocabulary file."""
    if (key := path or "") not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path)
    return _ENCODERS[key]


def with_end(ids: np.ndarray, end_id: int) -> np.ndarray:
    """The ids and the id that ends a document, as unsigned 32-bit little-endian integers."""
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = end_id
    return out
