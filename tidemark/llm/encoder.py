"""Exact ids of whole texts with word_bpe_49k.json, many times faster than text by text.

The tokenizer splits text into words before any merge, drops white space and treats each word alone, so the
ids of a text are the ids of its words in order. Numpy finds and hashes the words of a whole batch
(``lexer``), a hash table in the worker maps them to ids, and only unseen words go through the model.
Each hit in the table is confirmed on the word's length and bytes; a word that only shares a hash with a known one,
or is longer than lexer.LONG, goes through the model itself. Texts with apostrophes, special-token marks or
characters beyond Latin letters are cut at ASCII white space only, and their pieces go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from tidemark.llm import lexer

_PLAIN = re.compile(r"[^\x00-&(-\x7fÀ-ÖØ-öø-įı-ɏ]")
_SPACES = re.compile("[ \\n]")
_PIECE = re.compile("[^ \t\n\x0b\x0c\r]+")


def _byte_characters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """One per worker process: the caches live as long as the worker, and never hold more than ``most`` words."""

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.most = self.tokenizer.model, most
        self.names = [self.tokenizer.id_to_token(k) for k in range(self.tokenizer.get_vocab_size())]
        self.digits = [str(k) for k in range(len(self.names))]
        self.alphabet = dict(enumerate(_byte_characters()))
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)
        self.slot_word = np.zeros(1 << 16, np.int32)
        self.n_words, self.n_ids = 0, 0
        self.word_start = np.zeros(1 << 15, np.int64)
        self.word_count = np.zeros(1 << 15, np.int32)
        self.word_ids = np.zeros(1 << 16, np.uint16)
        self.word_size = np.zeros(1 << 15, np.int64)
        self.word_place = np.zeros(1 << 15, np.int64)
        self.word_bytes, self.n_bytes = np.zeros(1 << 18, np.uint8), 0
        self.pieces: dict[str, list[int]] = {}

    # The hash table: open addressing with linear probes, all words of a batch at once.

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The word number of each hash, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            found = self.keys[at]
            hit = found == h[todo]
            out[todo[hit]] = self.slot_word[at[hit]]
            on = ~hit & (found != 0)
            todo, at = todo[on], (at[on] + 1) & int(mask)
        return out

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Add hashes that differ from each other and from those inside."""
        while len(h):
            at = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
            while len(h):
                free = np.flatnonzero(self.keys[at] == 0)
                _, first = np.unique(at[free], return_index=True)
                win = free[first]
                self.keys[at[win]], self.slot_word[at[win]] = h[win], numbers[win]
                left = np.ones(len(h), bool)
                left[win] = False
                h, numbers, at = h[left], numbers[left], (at[left] + 1) & (len(self.keys) - 1)

    def _grow(self, words: int, ids: int, n_bytes: int) -> None:
        if 2 * words > len(self.keys):
            old, number = self.keys, self.slot_word
            size = 1 << (2 * words).bit_length()
            self.keys, self.slot_word = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(old[old != 0], number[old != 0])
        needs = {"word_start": words, "word_count": words, "word_size": words, "word_place": words, "word_ids": ids, "word_bytes": n_bytes + 8}
        for name, need in needs.items():
            array = getattr(self, name)
            if need > len(array):
                setattr(self, name, np.concatenate([array, np.zeros(max(need, 2 * len(array)) - len(array), array.dtype)]))

    def _merged(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.alphabet))]

    def _learn(self, w: lexer.Words, h: np.ndarray, missing: np.ndarray, short: np.ndarray) -> None:
        fresh, first = np.unique(h[missing], return_index=True)
        if self.n_words + len(fresh) > self.most:
            self._clear()
            missing = np.flatnonzero(short)
            fresh, first = np.unique(h[missing], return_index=True)
        raw = w.data.tobytes()
        start, end = w.start[missing[first]].tolist(), w.end[missing[first]].tolist()
        held = [raw[a:b] for a, b in zip(start, end, strict=True)]
        ids = [self._merged(x) for x in held]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        size = np.fromiter(map(len, held), np.int64, len(held))
        flat = np.fromiter((i for x in ids for i in x), np.uint16, int(count.sum()))
        n, m, k = self.n_words, self.n_ids, self.n_bytes
        self._grow(n + len(fresh), m + len(flat), k + int(size.sum()))
        self.word_ids[m : m + len(flat)] = flat
        self.word_count[n : n + len(fresh)] = count
        self.word_start[n : n + len(fresh)] = m + np.cumsum(count) - count
        self.word_bytes[k : k + int(size.sum())] = np.frombuffer(b"".join(held), np.uint8)
        self.word_size[n : n + len(fresh)] = size
        self.word_place[n : n + len(fresh)] = k + np.cumsum(size) - size
        self._put(fresh, np.arange(n, n + len(fresh), dtype=np.int32))
        self.n_words, self.n_ids, self.n_bytes = n + len(fresh), m + len(flat), k + int(size.sum())

    def _confirmed(self, w: lexer.Words, number: np.ndarray) -> np.ndarray:
        """Whether each word has the length and the bytes of the known word of that number (below 0: none)."""
        size = w.end - w.start
        same = (number >= 0) & (self.word_size[number] == size)
        # Hashes of words of up to seven bytes are their bytes, so length and hash are all there is to compare.
        todo, place = np.flatnonzero(same & (size > 7)), 0
        if len(todo):
            own = lexer.eights(w.data)
            known = np.ndarray(len(self.word_bytes) - 7, "<u8", self.word_bytes, strides=(1,))
        while len(todo):
            keep = lexer.first_bytes(size[todo] - place)
            differ = (own[w.start[todo] + place] ^ known[self.word_place[number[todo]] + place]) & keep != 0
            same[todo[differ]] = False
            place += 8
            todo = todo[~differ & (size[todo] > place)]
        return same

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        w = lexer.words([t.lower() for t in texts], lone_digits=True)
        h = w.hashes
        h[h == 0] = 1
        short = w.end - w.start <= lexer.LONG
        number = np.where(short, self._find(h), -1)
        missing = np.flatnonzero(short & (number < 0))
        if len(missing):
            self._learn(w, h, missing, short)
            number = np.where(short, self._find(h), -1)
        odd = np.flatnonzero(~self._confirmed(w, number)).tolist()
        number[odd] = 0
        count = self.word_count[number].astype(np.int64)
        alone = [self._merged(w.data[w.start[k] : w.end[k]].tobytes()) for k in odd]
        count[odd] = [len(x) for x in alone]
        ends = np.cumsum(count)
        source = np.repeat(self.word_start[number] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        ids = self.word_ids[np.minimum(source, len(self.word_ids) - 1)]
        for k, x in zip(odd, alone, strict=True):
            ids[ends[k] - len(x) : ends[k]] = x
        return ids, np.concatenate([[0], ends])[w.bounds]

    def _piecewise(self, text: str) -> np.ndarray:
        out: list[int] = []
        for piece in _PIECE.findall(text):
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= self.most // 8:
                    self.pieces.clear()
                ids = self.pieces[piece] = self.tokenizer.encode(piece, add_special_tokens=False).ids
            out += ids
        return np.array(out, np.uint16)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, bounds): those of text k are ids[bounds[k]:bounds[k + 1]]."""
        cut = [list(_pieces(t or "")) for t in texts]
        whole, parts = [p for x in cut for p in x], []
        sizes = np.zeros(len(whole), np.int64)
        for a, b in lexer.by_bytes(whole):
            own = whole[a:b]
            odd = [k for k, t in enumerate(own) if _PLAIN.search(t) or "<|" in t]
            slow = {k: self._piecewise(own[k]) for k in odd}
            flat, at = self._plain(["" if k in slow else t for k, t in enumerate(own)])
            if slow:
                flat = np.concatenate([slow.get(k, flat[at[k] : at[k + 1]]) for k in range(len(own))])
            parts.append(flat)
            sizes[a:b] = [len(slow[k]) if k in slow else at[k + 1] - at[k] for k in range(len(own))]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16), ends[np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)]

    def encode_exactly(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def _pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """A long text cut at white space, which no word crosses; others whole."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(" ", at + 1, at + limit), text.rfind("\n", at + 1, at + limit))
        if cut < 0:
            found = _SPACES.search(text, at + limit)
            if not found:
                break
            cut = found.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


