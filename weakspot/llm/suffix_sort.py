"""Exact substring dedup by two-stage suffix sorting.

Suffixes are dealt to shards so that equal ones meet: each window of `length` bytes picks, among the `GRAM`-byte grams in it,
the one of smallest hash, and windows of equal content pick the same gram. Neighbouring windows with one pick form a stretch.
Stretches whose gram stands once in the corpus are done with. The others' distinct contents, with their numbers of copies,
are gathered by gram, and each task sorts its suffixes in two stages: those not larger than their successor by comparing
bytes, all others by one scan of the buckets, from the order of their successors. Common prefixes of neighbours in that order
tell which windows stand elsewhere.

A gram with many different stretches is dealt again: its windows go in two halves by the gram's place in them, and all windows
of a half hold a longer string around the gram than the gram alone, by which they are dealt. Halves of halves come down to
single windows dealt by their whole content, so every shard is small in the end, whatever the corpus repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_grams, chunks, eight_bytes, id_and_text, materialize, mix, ranges, text_key, with_marks
from .graphs import together, whole_groups

LENGTH, GRAM = 400, 100
#: A shard with more different stretches is dealt again, so that no task gathers an unbounded one.
MOST_STRETCHES = 2000
#: Bytes of a text whose windows are looked at together; a longer text is taken in such segments.
PLACE_BITS = 24


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by block-wise running minima from both sides."""
    n = len(v)
    pad = -n % width
    blocks = np.append(v, np.full(pad, np.iinfo(v.dtype).max, dtype=v.dtype)).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """key, two names of the content, row, first window's byte in the row, number of windows, the gram's byte in the content."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    step, found = (1 << PLACE_BITS) - length, []
    for a in range(0, max(1, len(raw) - length + 1), step):
        found.append(_stretches(raw[a : a + step + length - 1], row[a : a + step + length - 1], length, gram))
        found[-1][4][:] += a
    key, one, two, row, first, count, pick = (np.concatenate(x) for x in zip(*found, strict=True))
    return key, one, two, row, first - offsets[row], count, pick


def _stretches(raw, row, length, gram):
    n, empty = len(raw), np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(row[: n - length + 1] == row[length - 1 :]) if n >= length else empty
    if not len(first):
        return [empty.astype(U64)] * 3 + [empty.copy() for _ in range(4)]
    name, other = byte_grams(raw, gram), byte_grams(raw, gram, 1)
    # smallest name, the first of equal ones: its leading bits, then its place
    least = _sliding_least((name >> U64(PLACE_BITS) << U64(PLACE_BITS)) | np.arange(len(name), dtype=U64), length - gram + 1)
    pick = (least[first] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (first[1:] != first[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(first)))
    first, pick = first[head], pick[head]
    end, place = first + count + length - 1, pick - first
    return [name[pick], content_names(name, first, end, gram, place), content_names(other, first, end, gram, place), row[first], first, count, place]


def content_names(grams: np.ndarray, first: np.ndarray, end: np.ndarray, gram: int, place: np.ndarray) -> np.ndarray:
    """Names of the strings [first, end), with their lengths and the gram's place in them, from the names of the grams that
    they are made of."""
    out = mix(grams[end - gram] ^ mix((place + (end - first << 32)).astype(U64), 6), 7)
    live, at = np.arange(len(first)), first
    while len(live):
        out[live] = mix(out[live] * U64(3) + grams[at], 8)
        at = at + gram
        keep = at + gram <= end[live]
        live, at = live[keep], at[keep]
    return out


def _stretch_rows(length: int):
    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                key, one, two, row, first, count, pick = stretches(raw, offsets, length)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (key, one, two)), part.column("doc_id").take(at), part.column("tk").take(at), *(pa.array(x.astype(np.int32)) for x in (first, count, pick))],
                    names=["key", "s1", "s2", "doc_id", "tk", "first", "count", "pick"],
                )

    return run


def _marks(part, offsets):
    """Rows, first windows (as bytes of the slice) and counts of the last column's list items; and the items."""
    column = part.column(part.num_columns - 1)
    lengths = np.where(np.asarray(column.is_null()), 0, np.diff(column.offsets.to_numpy())) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), lengths)
    first, count = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "count"))
    return row, first + offsets[row], count, flat


SHARD = "key long, s1 long, s2 long, n long, count int, pick int, low int, high int, content binary"


def _byte_rows(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                _, first, count, flat = _marks(part, offsets)
                data, m = raw.tobytes(), len(first)
                content = [data[a:b] for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)]
                low, high = pa.array(np.zeros(m, dtype=np.int32)), pa.array(np.full(m, length - gram, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("key", "s1", "s2", "n", "count", "pick")), low, high, pa.array(content, pa.binary())], names=["key", "s1", "s2", "n", "count", "pick", "low", "high", "content"])

    return run


def halves(content: bytes, count: int, pick: int, low: int, high: int, length: int):
    """The stretch's windows in which the gram's place is in either half of [low, high]: first window, windows, the half's
    bounds, and the string around the gram that all windows of the half hold."""
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        least, most = max(a, pick - count + 1), min(b, pick)
        if least <= most:
            yield pick - most, most - least + 1, a, b, content[pick - a : pick + length - b]


PART = "key long, s1 long, s2 long, n long, count int, pick int, low int, high int, content binary, of_key long, of_s1 long, of_s2 long, start int"


def _name(data: bytes, salt: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=bytes([salt])).digest(), "little", signed=True)


def _half_rows(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for start, many, a, b, shared in halves(r["content"], r["count"], r["pick"], r["low"], r["high"], length):
                    content, tag = r["content"][start : start + many + length - 1], f"{a},{b},{r['pick'] - start},".encode()
                    out.append((_name(f"{a},{b},".encode() + shared, 0), _name(tag + content, 1), _name(tag + content, 2), r["n"], many, r["pick"] - start, a, b, content, r["key"], r["s1"], r["s2"], start))
            kinds = (pa.int64(),) * 4 + (pa.int32(),) * 4 + (pa.binary(),) + (pa.int64(),) * 3 + (pa.int32(),)
            names = [x.split(" ")[0] for x in PART.split(", ")]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; zeros beyond the end."""
    return eight_bytes(data).byteswap()


def sort_directly(suffixes: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first `length` bytes: 8 bytes at a time, and only where suffixes are still tied."""
    order = suffixes[np.argsort(words[suffixes], kind="stable")]
    live = np.arange(len(order))
    word = words[order]
    group = np.cumsum(np.append(0, word[1:] != word[:-1])) if len(order) else live
    for depth in range(8, length, 8):
        live, group = _tied(live, group)
        if not len(live):
            break
        word = words[order[live] + depth]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        apart = np.zeros(group[-1] + 1, dtype=bool)
        apart[group[word != np.repeat(word[head], np.diff(np.append(head, len(live))))]] = True
        part = np.flatnonzero(apart[group])
        if len(part):
            by = np.lexsort((word[part], group[part]))
            order[live[part]] = order[live[part]][by]
            word[part] = word[part][by]
        group = np.cumsum(np.append(0, (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
    return order


def _tied(live, group):
    keep = np.bincount(group)[group] > 1
    live, group = live[keep], group[keep]
    return live, np.cumsum(np.append(0, group[1:] != group[:-1])) if len(group) else group


def two_stage_order(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The suffixes at `starts` (ascending) in the order of their first `length` bytes."""
    padded = np.append(data, np.zeros(length + 16, dtype=np.uint8))
    inside = np.zeros(len(padded), dtype=bool)
    inside[starts] = True
    # a suffix larger than its successor needs the successor in the set
    more = starts
    while len(more):
        more = more[padded[more] > padded[more + 1]] + 1
        more = more[~inside[more]]
        inside[more] = True
    every = np.flatnonzero(inside)
    direct = every[padded[every] <= padded[every + 1]]
    direct = sort_directly(direct, _words(padded), length)
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced_by = np.zeros(len(padded) + 1, dtype=bool)
    induced_by[every[padded[every] > padded[every + 1]]] = True
    by_first = np.split(direct, np.searchsorted(padded[direct], np.arange(1, 256)))
    out = []
    for c in range(256):
        # a bucket's induced suffixes have a second byte under c and so come before its direct ones
        bucket = np.concatenate([*buckets[c], by_first[c]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced_by[before]]
        if len(before):
            firsts = padded[before]
            by = np.argsort(firsts, kind="stable")
            cuts = np.flatnonzero(np.diff(firsts[by])) + 1
            for part in np.split(before[by], cuts):
                buckets[padded[part[0]]].append(part)
    order = np.concatenate(out)
    wanted = np.zeros(len(padded), dtype=bool)
    wanted[starts] = True
    return order[wanted[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in the order, up to `length`; 0 for the first."""
    words = _words(np.append(data, np.zeros(length + 16, dtype=np.uint8)))
    out = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    for depth in range(0, length, 8):
        if not len(live):
            break
        differ = words[order[live] + depth] ^ words[order[live - 1] + depth]
        same = differ == 0
        # equal leading bytes of the first word that differs
        d = differ[~same]
        lead = np.zeros(len(d), dtype=np.int64)
        for k in range(1, 8):
            lead += (d >> U64(64 - 8 * k)) == 0
        out[live[~same]] = depth + lead
        live = live[same]
    out[live] = length
    return np.minimum(out, length)


def _sorted_rows(length: int):
    def run(batches):
        for table, bounds in whole_groups(batches, ["key"], 2048):
            content = table.column("content").chunk(0)
            offsets = np.frombuffer(content.buffers()[1], dtype=np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
            data = np.frombuffer(content.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
            begin, count = offsets[:-1] - offsets[0], table.column("count").to_numpy().astype(np.int64)
            starts, owner = ranges(begin, count), np.repeat(np.arange(len(begin)), count)
            order = two_stage_order(data, starts, length)
            long = common_prefixes(data, order, length) >= length
            again = np.zeros(len(data), dtype=bool)
            again[order[long]] = True
            again[order[np.flatnonzero(long) - 1]] = True
            again = again[starts] | (table.column("n").to_numpy() > 1)[owner]
            found = np.flatnonzero(again)
            if not len(found):
                continue
            edge = np.append(True, (found[1:] != found[:-1] + 1) | (owner[found[1:]] != owner[found[:-1]]))
            head = np.flatnonzero(edge)
            size = np.diff(np.append(head, len(found)))
            own = owner[found[head]]
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks().take(take) for c in ("key", "s1", "s2")), pa.array((starts[found[head]] - begin[own]).astype(np.int32)), pa.array(size.astype(np.int32))],
                names=["key", "s1", "s2", "from", "many"],
            )

    return run


NAMES = ["key", "s1", "s2"]


def repeated_in(shards: DataFrame, length: int) -> DataFrame:
    """key, s1, s2, from, many: the windows of the stretches that stand twice or more in their shard. shards: see SHARD."""
    large = materialize(shards.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_STRETCHES).select("key"), "large")
    found = "key long, s1 long, s2 long, from int, many int"
    again = together(shards.join(large, "key", "left_anti"), ["key"], ["s1", "s2"]).mapInArrow(_sorted_rows(length), found)
    if not large.limit(1).count():
        return materialize(again, "again", large)
    again = materialize(again, "again")
    # equal parts of different stretches are one stretch of the next round, with all their copies
    parts = materialize(shards.join(large, "key", "left_semi").mapInArrow(_half_rows(length), PART), "parts", large)
    once = parts.groupBy(*NAMES).agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("count", "pick", "low", "high", "content")])
    once = materialize(once, "halves")
    inner = repeated_in(once, length)
    back = parts.join(inner, NAMES).select(F.col("of_key").alias("key"), F.col("of_s1").alias("s1"), F.col("of_s2").alias("s2"), (F.col("start") + F.col("from")).alias("from"), "many")
    return materialize(again.union(back), "again", again, parts, once, inner)


def _kept_rows(length: int):
    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                _, first, count, _ = _marks(part, offsets)
                change = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(change, first, 1)
                np.add.at(change, first + count + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                ids = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1] | (ids[1:] != ids[:-1])
                rows = len(offsets) - 1
                removed = np.bincount(ids[gone], minlength=rows)
                spans = np.bincount(ids[begins], minlength=rows)
                kept = [raw[a:b].tobytes() if not r else raw[a:b][~gone[a:b]].tobytes() for a, b, r in zip(offsets, offsets[1:], removed, strict=False)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed.astype(np.int64)), "n_spans": pa.array(spans.astype(np.int64)),
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "text": pa.array([x.decode(errors="replace") for x in kept], pa.string()),
                })

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts anywhere else in the corpus.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and text (the remaining bytes as text; a
    character of which a part was removed reads as U+FFFD) for each row of docs. Texts are UTF-8 bytes, null ones empty;
    matches never go over a text's end; overlaps count; strings are judged on the input. Repeated rows are each other's
    copies; rows of one doc_id and different texts are texts of their own; null is an id like others. Other columns are
    ignored; an empty table gives no rows.
    """
    docs = id_and_text(docs)
    known = docs.where("text is not null").withColumn("tk", text_key())
    rows = materialize(known.mapInArrow(_stretch_rows(length), "key long, s1 long, s2 long, doc_id long, tk long, first int, count int, pick int"), "stretches")
    keys = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    rows = materialize(rows.join(keys, "key", "left_semi"), "shared", rows, keys)
    once = rows.groupBy(*NAMES).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tk", "first", "count", "pick")).alias("one"))
    asked, lists = with_marks(known, once.select("one.*", *NAMES, "n"), only=True)
    # rows that repeat a doc_id and a text give a stretch once each, which changes nothing: its windows are found twice anyway
    shards = materialize(asked.mapInArrow(_byte_rows(length, GRAM), SHARD), "shards", lists)
    again = repeated_in(shards, length)
    marks = rows.join(again, NAMES).select("doc_id", "tk", (F.col("first") + F.col("from")).alias("first"), F.col("many").alias("count"))
    marked, _ = with_marks(docs, marks, rows, again, shards)
    return marked.mapInArrow(_kept_rows(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
