"""Token ids of whole texts by a public word-level BPE tokenizer, with a cache over pieces of text.

Tokens of this vocabulary never cross ASCII white space, and its normalizer treats
what white space separates on its own, so that a text's ids are those of its pieces
one after another. The library encodes the pieces that the cache misses, many in one
call: plain words by the tokenizer's model without its normalizer (they end in one
token that is marked as a word's last), other pieces by the tokenizer as it is (their
offsets tell them apart)."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

#: Bytes of the pieces kept by a worker, about; beyond that the cache starts anew.
CACHE_BYTES = 200_000_000
#: What an entry takes besides its piece and ids.
ENTRY_BYTES = 190
#: Id that ends each document.
END = 1

_encoders: dict[str, "Encoder"] = {}
#: Letters a-z and those of Latin-1: stable under normalization, letters in lower case too.
_plain = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _pieces(raw: bytes) -> list[bytes]:
    """What ASCII white space separates, A-Z in lower case where the tokenizer's ids don't depend on it.

    The tokenizer composes letters and marks before it lowers letters, and some capitals compose with no mark that their
    small letters compose with. Marks that compose with A-Z are in U+0300-U+036F, which begin with the bytes CC and CD."""
    if b"\xcc" in raw or b"\xcd" in raw:
        return [p.lower() if p.isascii() else p for p in raw.split()]
    return raw.lower().split()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        # the library cuts a text at its added tokens before it does anything else; what is between them is ordinary text,
        # also where it reads like one only in lower case
        self.added = {}
        for i, a in self.full.get_added_tokens_decoder().items():
            if a.single_word or a.lstrip or a.rstrip or a.normalized:
                raise ValueError(f"added token with flags: {a.content}")
            self.added[a.content] = np.array([i], "<u4")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.full.encode_special_tokens = True
        self.words = Tokenizer(self.full.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}
        self.size = 0

    def _words(self, words: list[bytes]) -> None:
        low = [w.decode("utf-8").lower() for w in words]
        lines = [" ".join(low[i : i + 64]) for i in range(0, len(low), 64)]
        ids = np.fromiter(chain.from_iterable([e.ids for e in self.words.encode_batch_fast(lines, add_special_tokens=False)]), "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            return self._others(words)
        raw, at = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist()):
            self.kept[w] = raw[at:end]
            at = end

    def _others(self, pieces: list[bytes]) -> None:
        texts = [p.decode("utf-8") for p in pieces]
        for at in range(0, len(texts), 1024):
            part = texts[at : at + 1024]
            e = self.full.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets))
            cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in part]), "left")
            raw, last = np.array(e.ids, "<u4").tobytes(), 0
            for p, c in zip(pieces[at : at + 1024], (4 * cuts).tolist()):
                self.kept[p] = raw[last:c]
                last = c

    def _learn(self, pieces: set[bytes]) -> None:
        kept, words, others, split = self.kept, set(), [], []
        for p in pieces:
            word = p.rstrip(b".,;:!?")
            if _plain(word):
                if len(word) < len(p):
                    # a run of letters and a run of marks after it are two words of the tokenizer
                    tail = p[len(word) :]
                    split.append((p, word, tail))
                    if tail not in kept and tail not in pieces:
                        others.append(tail)
                if word not in kept:
                    words.add(word)
            else:
                others.append(p)
        if words:
            self._words(list(words))
        if others:
            self._others(list(set(others)))
        for p, word, tail in split:
            kept[p] = kept[word] + kept[tail]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers, without the end id."""
        if not self.cut or not any(map(self.cut.search, texts)):
            return self._encode_all(texts)
        parts = [self.cut.split(t) for t in texts]  # every second part is an added token
        got = iter(self._encode_all([x for p in parts for x in p[::2]]))
        return [np.concatenate([self.added[x] if k % 2 else next(got) for k, x in enumerate(p)]) for p in parts]

    def _encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 256):
            parts = [_pieces(t.encode("utf-8", "replace")) for t in texts[at : at + 256]]
            got = [list(map(self.kept.get, p)) for p in parts]
            if new := {w for p, g in zip(parts, got) if None in g for w, v in zip(p, g) if v is None}:
                # ids take less than 4 bytes for each of a piece
                size = sum(map(len, new)) * 3 + ENTRY_BYTES * len(new)
                if self.size + size > CACHE_BYTES:
                    self.kept.clear()
                    self.size, new = 0, set().union(*parts)
                    size = sum(map(len, new)) * 3 + ENTRY_BYTES * len(new)
                self.size += size
                self._learn(new)
                kept = self.kept
                got = [[kept[w] if v is None else v for w, v in zip(p, g)] if None in g else g for p, g in zip(parts, got)]
            out += [np.frombuffer(b"".join(g), "<u4") for g in got]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
