"""Token ids of whole texts by a public tokenizer file, with the ids of recurring pieces kept until the caller forgets them.

Texts are cut only where the tokenizer itself always cuts: before a single space between two characters that are not
white space, and between a letter and ASCII punctuation. The ids of a text are then those of its pieces in a row, and
a piece that was seen before costs a lookup. A text with the string of an added token, such as <|endoftext|>, is encoded
whole, as that string is one id wherever it stands.
"""

from __future__ import annotations

from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from ridertide.llm.arrays import flat, ranges, strings

#: A worker forgets its pieces when it holds so many; they are then encoded again.
MOST_PIECES = 800_000
#: How byte-level vocabularies write the space before a word.
SPACE = "\u0120"

LETTERS = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printing else next(others)) for b in range(256)}


class Pieces:
    """Encodes batches of texts; `lower` for the vocabulary of lower-case words that drops white space."""

    def __init__(self, file: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.lower = self.tokenizer.normalizer is not None
        self.written = byte_characters()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def learn(self, new: list[str]) -> None:
        """Encode new pieces. A run of letters is one word to the tokenizer and goes straight to its merges."""
        merges, whole = self.model.tokenize, self.tokenizer.encode
        pieces_ = pa.array(new, pa.string())
        letters = np.asarray(pa.compute.match_substring_regex(pieces_, LETTERS))
        ascii_ = np.asarray(pa.compute.string_is_ascii(pieces_))
        if self.lower:
            written = pa.compute.utf8_lower(pa.compute.utf8_ltrim(pieces_, " "))
        else:
            written = pa.compute.replace_substring(pieces_, " ", SPACE, max_replacements=1)
        found: list[list[int]] = [[]] * len(new)
        plain = np.flatnonzero(letters & ascii_)
        for i, word in zip(plain.tolist(), written.take(pa.array(plain)).to_pylist(), strict=True):
            found[i] = [x.id for x in merges(word)]
        for i in np.flatnonzero(letters & ~ascii_).tolist():
            word = new[i].lstrip(" ").lower() if self.lower else new[i]
            found[i] = [x.id for x in merges(word.encode().decode("latin-1").translate(self.written))]
        for i in np.flatnonzero(~letters).tolist():
            found[i] = whole(new[i], add_special_tokens=False).ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        k, n = len(self.known), self.used + int(lengths.sum())
        while n > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while k + len(new) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        self.ids[self.used : n] = np.fromiter(chain.from_iterable(found), np.uint32, n - self.used)
        self.starts[k + 1 : k + 1 + len(new)] = self.used + np.cumsum(lengths)
        self.used = n
        self.known.update(zip(new, range(k, k + len(new)), strict=True))

    def with_added(self, texts: pa.Array) -> np.ndarray:
        """Which texts may have the string of an added token, in any case if the tokenizer ignores case."""
        found = np.zeros(len(texts), bool)
        for token in self.added:
            # A plain search for the token's first two characters leaves few texts for the search in any case.
            if pa.compute.any(pa.compute.match_substring(texts, token[:2])).as_py():
                has = pa.compute.match_substring(texts, token, ignore_case=self.lower)
                found |= np.asarray(has.fill_null(False))
        return found

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text), the id `end` after each text. A null text is empty."""
        special = np.flatnonzero(self.with_added(texts))
        if not len(special):
            return self.encode_pieces(texts, end)
        mask = np.zeros(len(texts), bool)
        mask[special] = True
        ids, bounds = self.encode_pieces(pa.compute.if_else(pa.array(mask), "", texts), end)
        parts, last, more = [], 0, np.zeros(len(texts) + 1, np.int64)
        for i in special.tolist():
            own = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            parts += [ids[last : bounds[i]], own]
            last, more[i + 1] = bounds[i], len(own)
        return np.concatenate([*parts, ids[last:]]), bounds + np.cumsum(more)

    def encode_pieces(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without the string of an added token."""
        data, offsets = flat(texts)
        cut = boundaries(data)
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        coded = strings(data, cuts).dictionary_encode() if len(data) else None
        if coded is None:
            return np.full(len(texts), end, np.uint32), np.arange(len(texts) + 1, dtype=np.int64)
        if len(self.known) > MOST_PIECES:
            self.forget()
        distinct = coded.dictionary.to_pylist()
        if new := [x for x in distinct if x not in self.known]:
            self.learn(new)
        vocabulary = list(map(self.known.__getitem__, distinct))
        piece = np.array(vocabulary, np.int64)[coded.indices.to_numpy()]
        lengths = self.starts[piece + 1] - self.starts[piece]
        by_piece = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(lengths, out=by_piece[1:])
        bounds = by_piece[np.searchsorted(cuts, offsets)] + np.arange(len(offsets))
        out = np.full(int(bounds[-1]), end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[bounds[1:] - 1] = False
        out[inner] = self.ids[ranges(self.starts[piece], lengths)]
        return out, bounds


def boundaries(data: np.ndarray) -> np.ndarray:
    """For each byte, and the end: may a text be cut before it without changing its ids?"""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) < 3:
        return cut
    plain = (data > 0x20) & (data < 0x7F)
    # Letters of two bytes that lead with 0xC3; longer characters and 0xC2 may be white space and are left alone.
    tail = np.zeros(len(data), bool)
    tail[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    before = plain | tail
    after = plain | (data == 0xC3)
    space = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    folded = data | 0x20
    letter = ((folded >= 0x61) & (folded <= 0x7A) & (data < 0x80)) | tail
    mark = plain & ~letter & ~((data >= 0x30) & (data <= 0x39))
    cut[1:-1] = letter[:-1] & mark[1:]
    cut[1:-2] |= space
    return cut


@cache
def pieces(file: str) -> Pieces:
    """One encoder for each file and worker."""
    return Pieces(file)
