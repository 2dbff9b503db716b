"""Token ids of whole texts, with a cache of the pieces between spaces."""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Pieces that a worker's cache holds before it starts anew.
CACHE_PIECES = 1_000_000
#: Characters of text encoded at once.
CHUNK_CHARS = 4 << 20
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SPACE_BEFORE_SPACE = re.compile(r"\s ")
#: Letters that normalisation leaves alone and that have one lower-case form, whatever stands around them.
_LATIN_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")


class PieceEncoder:
    """Encodes texts with a tokenizers file, as ``encode(text, add_special_tokens=False)`` does.

    Both vocabularies split a text into words first and never look across the
    border between a visible character and the space after it, so the text is
    cut there and equal pieces are encoded once.  ``spaces``: "drop" where the
    tokenizer drops white space (any space is such a border), "keep" where a
    word takes the space before it along.  Texts with special tokens, in any
    case (only the exact spelling is one to the tokenizer), and with
    "keep" those with a space after other white space, are encoded whole.

    A piece of plain letters is one word to either tokenizer, so the file's
    model encodes it without the pattern that finds words.  That, the comma and
    stop below, and the borders hold for tokenizers of these two kinds; a file
    of another kind is refused.  Ids are ``width`` bytes wide, little-endian.
    """

    def __init__(self, path: str, spaces: str, width: int = 4, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if spaces not in ("drop", "keep"):
            raise ValueError(spaces)
        self.type = {2: "H", 4: "I"}[width]
        if sys.byteorder != "little" or array(self.type).itemsize != width:
            raise RuntimeError("ids are kept in the machine's order, which must be little-endian with integers of this width")
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"{self.tokenizer.get_vocab_size()} ids do not fit in {width} bytes")
        self.keep = spaces == "keep"
        self._check_kind(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache: dict[str, bytes] = {}
        self.cache_pieces = cache_pieces
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(tokens.values()) + 1, np.int64)
        self.token_bytes[list(tokens.values())] = [len(t.removesuffix(self.tokenizer.model.end_of_word_suffix or "")) for t in tokens]
        self.id_bytes = width
        self.newline, *marks = self._whole(["\n", ",", "."])
        self.marks = dict(zip(",.", marks, strict=True))
        added = self.tokenizer.get_added_tokens_decoder().values()
        # case-blind, as the text may be lower-cased before its pieces are encoded
        self.special = re.compile("|".join(re.escape(t.content) for t in added), re.IGNORECASE) if added else None

    def _check_kind(self, path: str) -> None:
        """Probe what the cutting relies on."""
        probe = "Ab, cd. ef" if self.keep else "ab, cd. ef"
        parts = ["Ab", ",", " cd", ".", " ef"] if self.keep else ["ab", ",", "cd", ".", "ef"]
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        if whole != [i for p in parts for i in self.tokenizer.encode(p, add_special_tokens=False).ids]:
            raise ValueError(f"{path} does not cut words as spaces={'keep' if self.keep else 'drop'!r} needs")

    def _whole(self, texts: list[str], tokenizer: Tokenizer | None = None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.type, e.ids).tobytes() for e in found]

    def _marked(self, text: str) -> str | None:
        """The text with a space before each piece but the first, or None where it must be encoded whole.

        A piece begins at a space that follows a visible character; with "keep",
        also at a newline alone between visible characters.  There a newline is
        put before the text, as no space stands before its first piece.
        """
        if "<|" in text and self.special and self.special.search(text):
            return None
        if not self.keep:
            return (text.lower() if text.isascii() else text).replace("\n", " ")
        if text[:1] in (" ", "\n") or "  " in text or " \n" in text:
            return None
        if _OTHER_SPACE.search(text):
            return None if text[:1].isspace() or _SPACE_BEFORE_SPACE.search(text) else "\n" + text
        if "\n" in text:
            if "\n " in text:
                return None
            if "\n\n" not in text:
                return "\n" + text.replace("\n", " \n")
        return "\n" + text

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, many in one call; the tokens' lengths tell where each word ends."""
        out = []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.words.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in some])
            places = self.id_bytes * np.concatenate([[0], np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1])
            raw, places = ids.astype(self.type).tobytes(), places.tolist()
            out += [raw[a:b] for a, b in zip(places, places[1:], strict=False)]
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Put pieces into the cache, as they are encoded where a space precedes them (or their own newline)."""
        cache, before = self.cache, " " if self.keep else ""
        # a comma or stop after a letter is a word of its own, so "word," is "word" and "," (but \u0130 lower-cases to more than a letter)
        ended = {p: p[:-1] for p in pieces if p[-1:] in (",", ".") and p[-2:-1].isalpha() and p[-2:-1] != "\u0130"}
        new = {*(pieces - ended.keys()), *ended.values()}.difference(cache)
        plain = list(filter(_LATIN_WORD.fullmatch, new))
        first = [p for p in new if p[:1] == "\n" and _LATIN_WORD.fullmatch(p, 1)] if self.keep else []
        other = list(new.difference(plain, first))
        cache.update(zip(plain, self._plain([before + p for p in plain] if self.keep else [p.lower() for p in plain]), strict=True))
        cache.update(zip(first, map(self.newline.__add__, self._plain([p[1:] for p in first])), strict=True))
        cache.update(zip(other, self._whole([p if p[:1] == "\n" else before + p for p in other]), strict=True))
        for piece, stem in ended.items():
            cache[piece] = cache[stem] + self.marks[piece[-1]]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.cache.get, pieces))
        missing = {p for p, ids in zip(pieces, found, strict=True) if ids is None}
        if len(self.cache) + len(missing) > self.cache_pieces:
            # the frequent pieces came first: keep those that came early
            self.cache = dict(islice(self.cache.items(), self.cache_pieces // 2))
        self._learn(missing)
        return [self.cache[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        marked = [self._marked(t) for t in texts]
        # one number for each piece, each distinct piece looked up once
        cut = pc.split_pattern(pa.array([t for t in marked if t is not None], pa.string()), " ")
        numbered = cut.values.dictionary_encode()
        known = self._known(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        number = numbered.indices.to_numpy()
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.id_bytes
        starts = np.cumsum(sizes) - sizes
        each = sizes[number]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = np.frombuffer(b"".join(known), self.type)[np.repeat(starts[number] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[cut.offsets.to_numpy()].tolist()
        own = zip(bounds, bounds[1:], strict=False)
        skip = 1 if self.keep else 0  # the newline put first
        return [
            np.frombuffer(self._whole([t])[0], self.type) if m is None else ids[a + skip : b]
            for t, m in zip(texts, marked, strict=True)
            for a, b in ((0, 0) if m is None else next(own),)
        ]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """For each text its ids; about ``CHUNK_CHARS`` of text are held at once."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                yield from self._encode_some(some)
                some, size = [], 0
        if some:
            yield from self._encode_some(some)


@functools.lru_cache(maxsize=4)
def encoder(path: str, spaces: str, width: int = 4, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One for each worker process, file, mode, width and size of cache."""
    return PieceEncoder(path, spaces, width, cache_pieces)


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
