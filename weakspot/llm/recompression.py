"""Substring dedup by recompression.

A round of recompression renames a text bottom-up: each maximal run of one symbol gets one name, then every symbol is dealt to
a left or right class by its name and each adjacent (left, right) pair gets one name. A name is made from the names of what it
stands for alone, 128 bits from the words' bytes on, so it is global: all executors give equal runs and pairs equal names
without a table of names, and equal substrings get equal symbols except near their ends. For each symbol the rounds also carry
the stretch of words that decided it; a window of `window` words that holds the whole stretch holds the symbol in whatever
text it stands.

Each window picks the symbol of smallest key among those it decides: its anchor. Equal windows have equal anchors, so

1. neighbouring windows with one anchor form a stretch; stretches whose anchor stands in one document only are done with;
2. a stretch is verified by its symbols: two stretches are equal if and only if the symbols that they decide agree, and the few
   words at either end that none of these stands for. A stretch that stands whole in a document of smaller doc_id marks all
   its windows;
3. where one anchor stands in different stretches, the first document of each stretch names its windows one by one in the same
   way, and those that also start in a document of smaller doc_id are marked.

A window that decides no symbol (say, inside a very long run) is its own anchor, so nothing is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slices, U64, Words, chunks, id_and_text, materialize, mix, ranges, small_batches, text_key, with_marks

WINDOW, ROUNDS = 50, 4
FAR = 1 << 40


def run_name(name: np.ndarray, length: np.ndarray, r: int) -> np.ndarray:
    return np.where(length > 1, mix(name ^ mix(length.astype(U64), 31 + r), 41 + r), name)


def pair_name(one: np.ndarray, two: np.ndarray, r: int) -> np.ndarray:
    return mix(one * U64(3) + mix(two, 61 + r), 71 + r)


def recompress(name: np.ndarray, other: np.ndarray, row: np.ndarray, rounds: int = ROUNDS):
    """Symbols after the rounds: both names, first word, word after the last, and the words [low, high) that decide it.

    Symbols that a text's end decides have low under 0 or high beyond all words. low and high never fall among the others.
    """
    n, low = len(name), np.arange(len(name), dtype=np.int64)
    start, high = low, low + 1
    for r in range(rounds if n else 0):
        # runs of one symbol; a run ends where the next symbol, not the next run, is known to differ
        same = (name[1:] == name[:-1]) & (other[1:] == other[:-1]) & (row[1:] == row[:-1])
        head = np.flatnonzero(np.append(True, ~same))
        length = np.diff(np.append(head, len(name)))
        every = np.ones(len(name), dtype=bool)
        wide_low, wide_high = _look(low, high, row, every, every)
        low, high = np.minimum.reduceat(wide_low, head), np.maximum.reduceat(wide_high, head)
        name, other, row, start = run_name(name[head], length, r), run_name(other[head], length, r + 500), row[head], start[head]
        # pairs of a left and a right symbol
        right = (mix(name, 51 + r) >> U64(63)).astype(bool)
        joins = np.zeros(len(name), dtype=bool)
        joins[:-1] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
        second = np.concatenate(([False], joins[:-1]))
        low, high = _look(low, high, row, right & ~second, ~right & ~joins)
        at = np.flatnonzero(joins)
        name[at], other[at] = pair_name(name[at], name[at + 1], r), pair_name(other[at], other[at + 1], r + 500)
        low[at], high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        keep = ~second
        name, other, row, start, low, high = name[keep], other[keep], row[keep], start[keep], low[keep], high[keep]
    return name, other, start, np.append(start[1:], n), low, high


def _look(low, high, row, leftwards, rightwards):
    """Widens what decided a symbol by what decided its neighbours, where those were looked at; a text's end decides nothing."""
    there = row[1:] == row[:-1]
    before = np.concatenate(([-FAR], np.where(there, low[:-1], -FAR)))
    after = np.append(np.where(there, high[1:], FAR), FAR)
    return np.where(leftwards, np.minimum(low, before), low), np.where(rightwards, np.maximum(high, after), high)


class Symbols:
    """The symbols of several texts' words that no text's end decides, and what is named by them."""

    def __init__(self, words: Words):
        self.words, n = words, len(words)
        name, other, start, stop, low, high = recompress(words.name, words.other, words.row)
        inner = np.flatnonzero((low >= 0) & (high <= n))
        self.name, self.start, self.stop, self.low, self.high = name[inner], start[inner], stop[inner], low[inner], high[inner]
        self.slices = [(Slices(words.name), Slices(name[inner])), (Slices(words.other, 1), Slices(other[inner], 1))]

    def names(self, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Both names of each stretch of words [first, end): of the symbols it decides and of the words before and after them."""
        i, j = np.searchsorted(self.low, first), np.searchsorted(self.high, end, side="right")
        some = np.flatnonzero(j > i)
        a, b = end.copy(), end.copy()  # words [a, b) are named by symbols
        a[some], b[some] = self.start[i[some]], self.stop[j[some] - 1]
        j = np.maximum(i, j)
        return [mix(mix(by_word(first, a) * U64(3) + by_symbol(i, j), 81) * U64(5) + by_word(b, end), 82) for by_word, by_symbol in self.slices]

    def anchors(self, window: int = WINDOW):
        """Stretches of windows that share an anchor: key, first window (a word's index), number of windows."""
        words, n = self.words, len(self.words)
        first = np.arange(max(0, n - window + 1))
        first = first[words.row[first] == words.row[first + window - 1]] if len(first) else first
        best, chosen = np.full(len(first), 2**64 - 1, dtype=U64), np.full(len(first), -1)
        if not len(first):
            return best, first, chosen
        short = np.flatnonzero(self.high - self.low <= window)
        low, high = self.low[short], self.high[short]
        key = mix(self.slices[0][0](low, high) ^ self.name[short], 5)
        # symbols k with first <= low and high <= first + window; neither falls, so they lie together
        i, j = np.searchsorted(low, first), np.searchsorted(high, first + window, side="right")
        live, step = np.flatnonzero(i < j), 0
        while len(live):
            k = i[live] + step
            better = key[k] < best[live]
            best[live[better]], chosen[live[better]] = key[k[better]], k[better]
            step += 1
            live = live[i[live] + step < j[live]]
        alone = chosen < 0
        best[alone] = self.slices[0][0](first[alone], first[alone] + window)
        new = np.ones(len(first), dtype=bool)
        new[1:] = alone[1:] | (chosen[1:] != chosen[:-1]) | (first[1:] != first[:-1] + 1)
        head = np.flatnonzero(new)
        return best[head], first[head], np.diff(np.append(head, len(first)))


ROW = "key long, s1 long, s2 long, doc_id long, tk long, first int, count int"


def _anchor_rows(window: int):
    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                words = Words(raw, offsets)
                symbols = Symbols(words)
                key, first, count = symbols.anchors(window)
                one, two = symbols.names(first, first + count + window - 1)
                row = words.row[first] if len(first) else first
                yield _rows(part, ("key", key), ("s1", one), ("s2", two), row=row, first=first - words.first[row], count=count)

    return run


def _rows(part, *names, row, first, count) -> pa.RecordBatch:
    """Names as signed numbers, the row's doc_id and tk, and the place."""
    at = pa.array(row.astype(np.int64))
    columns = [pa.array(v.view(np.int64)) for _, v in names] + [part.column("doc_id").take(at), part.column("tk").take(at), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=[k for k, _ in names] + ["doc_id", "tk", "first", "count"])


def _window_rows(window: int):
    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                words = Words(raw, offsets)
                firsts, counts, rows = _stretches(part.column(part.num_columns - 1), words, window)
                at = ranges(firsts, counts)
                row = np.repeat(rows, counts)
                one, two = Symbols(words).names(at, at + window)
                yield _rows(part, ("s1", one), ("s2", two), row=row, first=at - words.first[row], count=np.ones(len(at), dtype=np.int64))

    return run


def _stretches(column, words, window):
    """The (first, count) structs of the list column as word indexes of the whole slice, and their rows."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    flat = column.flatten()
    rows = np.repeat(np.arange(len(column)), lengths)
    firsts = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
    return firsts + words.first[rows], counts, rows


def _kept(part, raw, offsets, window: int):
    """Words, removed words and the kept words' bytes of each row; the last column holds the marks."""
    words = Words(raw, offsets)
    firsts, counts, _ = _stretches(part.column(part.num_columns - 1), words, window)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, firsts, 1)
    np.add.at(gone, firsts + counts + window - 1, -1)
    gone = np.cumsum(gone[:-1]) > 0
    n = np.diff(words.first)
    removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
    data, start, end, first = raw.tobytes(), words.start, words.end, words.first
    single = np.append((start[1:] == end[:-1] + 1) & (raw[end[:-1]] == 0x20), False) if len(start) else np.zeros(0, bool)
    kept = []
    for i in range(part.num_rows):
        a, b = first[i], first[i + 1]
        if not removed[i] and (b - a < 2 or single[a : b - 1].all()):
            kept.append(data[start[a] : end[b - 1]] if b > a else b"")
        else:
            kept.append(_joined(data, start, end, single, np.flatnonzero(~gone[a:b]) + a))
    return n, removed, kept


def _kept_rows(window: int):
    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                n, removed, kept = _kept(part, raw, offsets, window)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_words": pa.array(n), "n_removed": pa.array(removed),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "text": pa.array(kept, pa.binary()).cast(pa.string()),
                })

    return run


def _replaced_rows(window: int):
    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                _, removed, kept = _kept(part, raw, offsets, window)
                columns = dict(zip(part.schema.names[:-1], part.columns, strict=False))
                changed = pa.array(removed > 0)
                new = pa.array([x if r else None for x, r in zip(kept, removed, strict=True)], pa.binary()).cast(columns["text"].type)
                columns["text"] = pc.if_else(changed, new, columns["text"])
                if "n_chars" in columns:
                    columns["n_chars"] = pc.if_else(changed, pc.utf8_length(new).cast(columns["n_chars"].type), columns["n_chars"])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _joined(data, start, end, single, keep) -> bytes:
    """The kept words joined by one space; stretches that are so joined already are copied whole."""
    if not len(keep):
        return b""
    cut = np.flatnonzero((np.diff(keep) > 1) | ~single[keep[:-1]])
    begin, stop = keep[np.append(0, cut + 1)], keep[np.append(cut, len(keep) - 1)]
    return b" ".join([data[a:b] for a, b in zip(start[begin].tolist(), end[stop].tolist())])


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes each word covered by a window of `window` consecutive words that also starts in a document of smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and text (kept words joined by one space). Every row of docs gives one row.
    Null and empty texts have no words; a text shorter than the window keeps all of them. Windows are judged on the input.
    Rows that share a doc_id are one document: none of them is another's copy, and each is judged by its own text. Rows of null
    doc_id keep all words and are no one's copy. Other columns are ignored; an empty table gives no rows.
    """
    docs = id_and_text(docs)
    marked, _ = with_marks(docs, *repeated_windows(docs, window))
    return marked.mapInArrow(_kept_rows(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words that substring_dedup removes taken out of text, and n_chars set anew; other texts stay as they are.

    A changed text is its kept words joined by one space. All rows and columns of docs stay.
    """
    small_batches(docs.sparkSession)
    marked, _ = with_marks(docs, *repeated_windows(id_and_text(docs), window))
    return marked.mapInArrow(_replaced_rows(window), docs.schema)


def repeated_windows(docs: DataFrame, window: int) -> tuple[DataFrame, ...]:
    """doc_id, tk, first, count: stretches of windows that also start in a document of smaller doc_id; and the tables behind.

    docs: doc_id, text. The tables are spent once the stretches are written.
    """
    known = docs.where("doc_id is not null and text is not null").withColumn("tk", text_key())
    rows = materialize(known.mapInArrow(_anchor_rows(window), ROW), "stretches")
    keys = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key"), "keys")
    # sort-merge at every size: a table small enough to be broadcast here isn't so on a larger corpus
    rows = materialize(rows.join(keys.hint("merge"), "key", "left_semi"), "shared", rows, keys)
    stretch = ["key", "s1", "s2"]
    firsts = materialize(rows.groupBy(*stretch).agg(F.min("doc_id").alias("least")), "firsts")
    mixed = materialize(firsts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "mixed")
    held = rows.join(firsts.hint("merge"), stretch)
    marked = held.where("doc_id > least").select("doc_id", "tk", "first", "count")
    ask = held.where("doc_id = least").join(mixed, "key", "left_semi").select("doc_id", "tk", "first", "count")
    asked, lists = with_marks(known, ask, mixed, only=True)
    windows = materialize(asked.mapInArrow(_window_rows(window), "s1 long, s2 long, doc_id long, tk long, first int, count int"), "windows", lists)
    least = windows.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = materialize(least, "least")
    single = windows.join(least, ["s1", "s2"]).where("doc_id > least").select("doc_id", "tk", "first", "count")
    return marked.union(single), rows, firsts, windows, least
