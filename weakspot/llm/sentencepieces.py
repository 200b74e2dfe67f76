"""SentencePiece encoding of merge-type models by backtracking, and decoding.

A text is a chain of tokens; the merges would give just this chain if each two neighbours, taken alone, would stay as they
are. So no merge queue is needed: an Aho-Corasick automaton finds the longest token at every place, a token is tried there,
its pair with the token before is checked by re-merging the two (once for each pair), and where it doesn't fit the next
shorter token is tried; where none fits, the token before goes back and a bit marks its end as failed. Each place fails at
most once.

Texts are cut before each space mark that follows another character (no piece of such a model goes over that place) and at
characters that are in no piece, which become byte tokens. Each distinct cut is encoded once in a worker.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, id_and_text
from .tokens import Cache

MARK = "▁"
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6


class Model:
    """A merge-type model file. Anything that the method doesn't cover is refused at loading."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        norm, trained = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces}
        marks_inside = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces if p.type == NORMAL)
        if trained.model_type != 2 or trained.treat_whitespace_as_suffix or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or kinds & {USER_DEFINED, UNUSED} or marks_inside:
            raise ValueError("only merge-type models without normalisation, defined pieces or inner space marks")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.score = {p.piece: (-p.score, i) for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.unknown, self.fallback = self.library.unk_id(), trained.byte_fallback
        # pieces that the merges reach; only these can be tokens
        self.tokens = {x for x in self.id if self.merge(x) == [x]}
        self.known = {x for x in self.tokens if len(x) == 1}
        self.find = ahocorasick.Automaton()
        for x in self.tokens:
            self.find.add_word(x, x)
        self.find.make_automaton()
        self.shorter = {x: next((x[:n] for n in range(len(x) - 1, 0, -1) if x[:n] in self.tokens), None) for x in self.tokens}
        self.fits = Cache(lambda pair: self.merge(pair[0] + pair[1]) == [*pair])
        self.chunk = Cache(self._chunk)
        self.after_space = Cache(lambda word: self._chunk(MARK + word))

    def merge(self, text: str) -> list[str]:
        """The merges themselves, best score first, leftmost among equals; used on single pieces and pairs only."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def backtrack(self, text: str) -> list[str]:
        """Tokens of a text of known characters."""
        n, longest, fits, shorter = len(text), {}, self.fits, self.shorter
        for end, token in self.find.iter(text):
            longest[end - len(token) + 1] = token  # matches come by their ends, so the last is the longest
        failed, out, at = 0, [], 0
        token = longest.get(0)
        while at < n:
            before = out[-1] if out else None
            while token is not None:
                end = at + len(token)
                if not failed >> end & 1 and (before is None or fits[before, token]):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                at = end
                token = longest.get(at)
            else:
                failed |= 1 << at
                token = out.pop()
                at -= len(token)
        return out

    def ids(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        if self.known.issuperset(text):
            return [self.id[x] for x in self.backtrack(text)]
        out, last = [], 0
        for i, c in enumerate(text):
            if c not in self.known:
                out += map(self.id.__getitem__, self.backtrack(text[last:i]))
                if self.fallback:
                    out += [self.byte[b] for b in c.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
                last = i + 1
        return out + [self.id[x] for x in self.backtrack(text[last:])]

    def _chunk(self, text: str) -> tuple[str, tuple[int, ...]]:
        ids = self.ids(text)
        return "".join(f"{i}," for i in ids), tuple(ids)

    def pieces(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """(ids as text, ids) of the text's cuts in order."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or not self.fallback:
            text = self.prefix + text.replace(" ", MARK)
            return [self.chunk[x] for x in (re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", text) if self.fallback else [text])]
        out, apart = [], "\n" not in self.known
        for i, line in enumerate(text.split("\n") if apart else [text]):
            first, *rest = line.split(" ")
            if i:
                out.append(self.chunk["\n"])
                if first:
                    out.append(self.chunk[first])
            else:
                out.append(self.after_space[first] if self.prefix else self.chunk[first])
            out.extend(map(self.after_space.__getitem__, rest))
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(ids for _, ids in self.pieces(text)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode_decode(docs: DataFrame, path: str, outputs: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (null: empty); with `outputs` also ids and decoded.

    No begin or end ids. ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. One
    row for each row of docs, also repeated ones and those of null doc_id. Other columns are ignored.
    """

    def run(batches):
        m = model(path)
        for batch in batches:
            for part, _, _ in chunks(batch):
                n, one, two, ids_out, texts = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    pieces = m.pieces(text or "")
                    ids = list(chain.from_iterable([x[1] for x in pieces]))
                    decoded = m.decode(ids) if ids else ""
                    n.append(len(ids))
                    one.append(hashlib.sha256("".join([x[0] for x in pieces])[:-1].encode()).hexdigest())
                    two.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if outputs:
                        ids_out.append(ids)
                        texts.append(decoded)
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string())}
                if outputs:
                    columns |= {"ids": pa.array(ids_out, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * outputs)
