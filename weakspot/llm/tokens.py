"""Token ids of whole texts by the tokenizers library, with words encoded once per Python worker.

A text is cut at spaces and line feeds where the tokenizer's own pattern is known to cut, each piece goes through the file's
normaliser and pattern, and the library's merge model encodes each distinct result once. Texts or tokenizer files for which
the cut isn't known to be exact go to the library whole. Special tokens of the file are found in texts as the library finds
them by default: a text or piece that holds such a string goes to the library whole.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import unicodedata

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of a worker's caches; a full cache starts anew, which costs time but changes nothing.
CACHE = 700_000
LONGEST_CACHED = 48
#: White space other than single spaces and line feeds: a text that holds it goes to the byte-level library whole.
OTHER_SPACE = regex.compile(r"[^\S \n]|[\x1c-\x1f]")
DOUBLE = ("  ", "\n\n", " \n", "\n ")


#: Pieces with characters beyond these Latin ones go to the library, whose Unicode tables may differ from Python's.
LATIN = "\u024f"


class OtherSpace(Exception):
    pass


class Cache(dict):
    def __init__(self, make, most: int = CACHE):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


#: The patterns by which the two known kinds of file cut text into words (fixed values of the formats).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normaliser of the word-level kind (a fixed value of the format).
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Encoder:
    """encode(text) -> the ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.model, self.letters = self.library.model, byte_letters()
        pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        whole = {"add_prefix_space": False, "trim_offsets": True}
        ascii_special = all(s and not set(s) & {" ", "\n"} for s in self.special)
        plain = spec["model"]["type"] == "BPE" and not spec.get("post_processor") and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])) and ascii_special
        self.kind = ""
        if plain and not normalizer and pre == {"type": "ByteLevel", "use_regex": True} | whole:
            self.kind, self.pattern = "bytes", regex.compile(BYTE_LEVEL)
        elif plain and (normalizer or {}).get("normalizers") == WORD_NORMALIZERS and pre.get("pretokenizers") == [
            {"type": "Split", "pattern": {"Regex": WORD_LEVEL}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "use_regex": False} | whole,
        ]:
            self.kind, self.pattern = "words", regex.compile(WORD_LEVEL)
        self.table = str.maketrans({chr(b): c for b, c in self.letters.items()})
        self.first = Cache(self._piece, cache)
        self.later = Cache(lambda word: self._piece(" " + word), cache) if self.kind == "bytes" else self.first
        self.words = Cache(self._word, cache)
        self.newline = self._piece("\n") if self.kind == "bytes" else b""

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        # byte letters differ from ASCII only for the space and control characters
        letters = word if word.isalnum() and word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return self.pack(*[x.id for x in self.model.tokenize(letters)])

    @staticmethod
    def pack(*ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        plain = piece.isascii()
        if not plain and max(piece) > LATIN or self.marks and self.marks.search(piece):
            return self._library(piece)
        if self.kind == "bytes":
            if piece != "\n" and OTHER_SPACE.search(piece):
                raise OtherSpace
        else:
            piece = piece.lower() if plain else "".join(c.lower() for c in unicodedata.normalize("NFC", piece))
        found = self.pattern.findall(piece)
        return self.words[found[0]] if len(found) == 1 else b"".join(map(self.words.__getitem__, found))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.kind == "words":
            return b"".join(map(self.first.__getitem__, itertools.chain.from_iterable(line.split(" ") for line in text.split("\n"))))
        if self.kind != "bytes" or text[0] in " \n" or text[-1] in " \n" or any(d in text for d in DOUBLE):
            return self._library(text)
        try:
            return self._by_words(text)
        except OtherSpace:
            return self._library(text)

    def _by_words(self, text: str) -> bytes:
        out, first, later = [], self.first, self.later.__getitem__
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            out.extend(map(later, words[1:]))
            out.append(self.newline)
        out.pop()
        return b"".join(out)


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    if (path, cache) not in _encoders:
        _encoders[path, cache] = Encoder(path, cache)
    return _encoders[path, cache]
