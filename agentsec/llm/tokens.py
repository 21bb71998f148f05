"""Exact ids of the `tokenizers` library at the speed of a dictionary.

Encoding whole texts costs about half a CPU second a MB. Both vocabularies cut a text into pre-tokens before
merging, and a cut is certain where a single space stands between two non-space characters. So a text is cut
there, the distinct pieces of a group of texts are looked up, each is encoded once by the library, and the ids are remembered up to a limit; a new piece
that ends in punctuation after a letter or digit is two pre-tokens, looked up apart. A text with other white space
(seen when a new piece holds it or is empty), or with what may be a special token, goes to the library whole. A worker keeps its encoder between tasks
and drops it after IDLE seconds without use.
"""

from __future__ import annotations

import os
import re
import threading
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_LIMIT, GROUP_CHARS, IDLE = 200_000, 2 << 20, 4.0
#: What stands before the first word of a text and before closing punctuation (a text that holds them is not cut), and the
#: ids of an uncertain piece: no multiple of 4 bytes.
HEAD, TAIL, UNSURE = "\0", "\1", b"?"
#: What may follow a letter or digit as a pre-token of its own; an apostrophe may start a contraction instead.
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
CLOSING = "([A-Za-z0-9À-ÖØ-öø-ÿ])([" + "".join("\\" + c for c in PUNCTUATION) + "]+)$"
_kept: dict[tuple, Any] = {}
_timers: list[threading.Timer] = []


def drop_kept() -> None:
    """Forget what is kept between tasks and give its memory back to the system."""
    from .common import release_memory

    _kept.clear()
    release_memory()


def keep_alive() -> None:
    """Put off dropping what is kept between tasks; what is still in use goes on by its own reference."""
    while _timers:
        _timers.pop().cancel()
    timer = threading.Timer(IDLE, drop_kept)
    timer.daemon = True
    timer.start()
    _timers.append(timer)


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What a worker keeps under `key`, made at first use."""
    keep_alive()
    got = _kept.get(key)
    if got is None:
        got = _kept[key] = make()
    return got


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, str]:
    """Byte -> the printable character that byte-level vocabularies write for it: itself, or the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class Pieces(dict):
    """Piece -> ids as bytes, found by `make` at first use. Up to two times `limit` entries; those used lately stay."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        self[piece] = ids
        return ids


class Uncertain(ValueError):
    """A piece that isn't one word: its text has other white space than single spaces and line ends."""


class PieceEncoder:
    """encode(texts) -> one uint32 array of ids per text, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, spaced: bool):
        """spaced: the vocabulary keeps the space before a word (byte-level), so a piece is encoded with it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.mark = os.path.commonprefix([str(t) for t in self.tokenizer.get_added_tokens_decoder().values()])[:2]
        assert self.mark.lower() == self.mark.upper() != "", "special tokens must share a start without letters"
        # a run of these letters is one pre-token: the model is asked directly, in the byte alphabet of byte-level vocabularies
        self.letters, self.direct = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch, True
        self.tokenize, self.alphabet = self.tokenizer.model.tokenize, str.maketrans(byte_alphabet())
        self.front = " ".translate(self.alphabet) if spaced else ""
        tries = ["Hello", "naïve", "GRÜSSE", "thhewhing", "a", "ÿ"]
        if [self.word(w) for w in tries] != [self.library((" " if spaced else "") + w) for w in tries]:
            self.letters, self.direct = lambda w: None, False
        self.line_end = self.library("\n")
        self.marks = Pieces(self.library, 20_000)
        self.heads = Pieces(self.head, 50_000) if spaced else None
        self.pieces = Pieces(self.piece, PIECE_LIMIT)

    @classmethod
    def shared(cls, path: str, spaced: bool) -> PieceEncoder:
        return kept((path, spaced), lambda: cls(path, spaced))

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a run of letters, after a space where the vocabulary keeps it."""
        text = word if self.spaced else word.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokenize(self.front + text)]).tobytes()

    def head(self, word: str) -> bytes:
        """Ids of a word at the start of a text or line, where no space stands before it."""
        if word.split() != [word]:
            raise Uncertain
        core = word.rstrip(PUNCTUATION)
        if core != word and core and core[-1].isalnum():
            return self.heads[core] + self.marks[word[len(core) :]]
        return self.library(word)

    def piece(self, word: str) -> bytes:
        """Ids of a word after a space; of a line end and the word after it; or, marked so, of the first word or of closing punctuation."""
        if self.direct and word.isascii() and word.isalpha():
            return self.word(word)
        if word[:1] == TAIL:
            return self.marks[word[1:]]
        if word[:1] == HEAD:
            return self.heads[word[1:]]
        if word[:1] == "\n":
            return self.line_end + self.heads[word[1:]]
        if word.split() != [word]:
            raise Uncertain
        if self.letters(word):
            return self.word(word)
        core = word.rstrip(PUNCTUATION)
        if core != word and core and core[-1].isalnum():
            return self.pieces[core] + self.marks[word[len(core) :]]
        return self.library(" " + word if self.spaced else word)

    def known(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; UNSURE for one whose text the library must encode whole."""
        try:
            return list(map(self.pieces.__getitem__, pieces))
        except Uncertain:
            return [self.known_one(p) for p in pieces]

    def known_one(self, piece: str) -> bytes:
        try:
            return self.pieces[piece]
        except Uncertain:
            return UNSURE

    def whole(self, text: str) -> bool:
        """Whether a text must go to the library whole, as far as can be told before cutting it."""
        return self.mark in text or HEAD in text or TAIL in text or not self.spaced and self.line_end != b"" and "\n" in text

    def encode_parts(self, parts: list[str]) -> list[np.ndarray | None]:
        """Ids of each part, cut at single spaces; None where a piece is unsure.

        Arrow cuts the parts, finds their distinct words and cuts closing punctuation off those, so Python looks up each
        distinct piece once.
        """
        words, word_codes, part_bounds = distinct(parts)
        pieces, piece_codes, word_bounds = distinct(pc.replace_substring_regex(words, CLOSING, r"\1 " + TAIL + r"\2"))
        found = self.known(pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces), " ")[0].as_py().split(" "))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.frombuffer(b"".join(f if len(f) % 4 == 0 else bytes(4) for f in found) if (sizes % 4).any() else b"".join(found), np.uint32)
        unsure, sizes = sizes % 4 != 0, -(-sizes // 4)
        for codes, bounds in ((piece_codes, word_bounds), (word_codes, part_bounds)):
            flat, sizes = gather(flat, sizes, codes, bounds)
            unsure = np.diff(np.append(0, np.cumsum(unsure[codes]))[bounds]) > 0
        ends = np.cumsum(sizes)
        return [None if u else flat[end - n : end] for u, n, end in zip(unsure, sizes, ends)]

    def prepared(self, part: str, first: bool) -> str:
        """A part with its line ends, and its start in a byte-level vocabulary, as pieces of their own kind."""
        if not self.spaced:
            return part.replace("\n", " ")
        return (HEAD if first else "") + part.replace("\n", " \n")

    def encode_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of texts of at most GROUP_CHARS characters together, or of a single longer one."""
        if len(texts) == 1 and len(texts[0]) > GROUP_CHARS and not self.whole(texts[0]):
            found = [self.encode_parts([self.prepared(part, k == 0)])[0] for k, part in enumerate(cut(texts[0]))]
            yield np.frombuffer(self.library(texts[0]), np.uint32) if any(f is None for f in found) else np.concatenate(found)
            return
        sure = [not self.whole(t) for t in texts]
        parts = [self.prepared(t, True) for t, s in zip(texts, sure) if s]
        found = iter(self.encode_parts(parts) if parts else [])
        for text, s in zip(texts, sure):
            ids = next(found) if s else None
            yield np.frombuffer(self.library(text), np.uint32) if ids is None else ids

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        group, size = [], 0
        for text in texts:
            if group and size + len(text) > GROUP_CHARS:
                yield from self.encode_group(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self.encode_group(group)
        keep_alive()


def distinct(texts: list[str] | pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the word of each place as an index of those, bounds of each text's places) of texts cut at spaces."""
    cuts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = pc.dictionary_encode(cuts.flatten())
    return coded.dictionary, coded.indices.to_numpy(), cuts.offsets.to_numpy()


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of `flat`, in runs of `sizes`: the runs that `codes` name one after the other, and how many items lie in each of `bounds`."""
    starts, each = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
    ends = np.append(0, np.cumsum(each))
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], each)], np.diff(ends[bounds])


def cut(text: str) -> Iterator[str]:
    """Parts of a long text, cut at single spaces, which are left out."""
    at = 0
    while len(text) - at > GROUP_CHARS and (end := text.find(" ", at + GROUP_CHARS)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]
