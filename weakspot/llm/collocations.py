"""Phrase collocations: candidates from sketch bounds, counted by delimiter-guarded automata.

Two passes make count-min sketches, of words and then of the phrases whose words all reach the least count by their bounds: a
task adds up its buckets, pages of 65,536 buckets are summed after a shuffle, and of each page one bit a bucket is left. The
number of buckets follows the corpus up to a stated bound of memory. A third pass takes a bounded stretch of texts at a time,
gathers its distinct phrases whose bounds reach the least count in every row of the sketch, as do those of all phrases inside
them, compiles these into automata over " word word ", so that matches begin and end with words and never leave a piece, and
counts overlapping matches in that stretch. Whether a phrase is gathered depends on its words alone, so each stretch's automata
hold every gathered phrase that it has, and the stretches' counts add up to the corpus's. Bounds are never under the counts, so
the exact thresholds that follow lose nothing.
"""

from __future__ import annotations

import functools
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, CHUNK_BYTES, LEFT, U64, chunks, materialize, mix, small_batches, word_names

LEAST = 100
LONGEST = 5
MOST = 2000
#: Share of a phrase's count, in hundredths, from which a longer phrase around it replaces it.
INSIDE = 100
#: Rows of the sketch.
SALTS = (11, 12)
#: Buckets of a row: about one for 64 bytes of text, between these powers of two. The upper one, 32 MB of bits a row, bounds a
#: worker's memory and the broadcast; beyond 16 GB of text the sketch gets fuller, so more phrases are counted exactly.
FEWEST_BITS, MOST_BITS = 16, 28
PAGE_BITS = 16
#: Buckets that a task gathers before it adds them up.
GATHERED = 1 << 21
#: Phrases, bytes of phrases and bytes of texts that end a stretch; an automaton takes about 60 bytes for each of a phrase.
REMEMBERED = 1 << 20
AUTOMATON_BYTES = 4 << 20
STRETCH_BYTES = 32 << 20

PIECE_END = b".,;:!?\x0a\x0b\x0c\x0d"
#: Bytes of a text as the rules see them: small letters, one piece end, one space.
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_END + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(PIECE_END) + b" ")


def _folded(batch: pa.RecordBatch):
    """Folded bytes and languages of a batch's texts, a few at a time: raw, offsets, languages. A long text is cut at piece ends."""
    for part, raw, offsets in chunks(batch):
        langs = part.column("lang").to_pylist()
        text = raw.tobytes().translate(FOLDED)
        if len(text) <= 2 * CHUNK_BYTES:
            yield np.frombuffer(text, dtype=np.uint8), offsets, langs
            continue
        for lang, a, end in zip(langs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            while a < end:
                b = text.find(b"\n", a + CHUNK_BYTES, end)
                b = end if b < 0 else b + 1
                yield np.frombuffer(text, dtype=np.uint8, count=b - a, offset=a), np.array([0, b - a]), [lang]
                a = b


@functools.lru_cache(1024)
def _lang_name(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Phrases:
    """Words of folded texts and 64-bit names of the phrases that start at each of them, language included."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: list[str]):
        stop = raw == 10
        inside = ~stop & (raw != 32)
        first = np.zeros(len(raw) + 1, dtype=bool)
        first[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        self.raw, self.start, self.end = raw, np.flatnonzero(begins), np.flatnonzero(ends) + 1
        n = len(self.start)
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        piece = np.cumsum(stop)[self.start] + self.row  # rises with every piece end and every text
        last = np.append(piece[1:] != piece[:-1], True)[:n]
        after = np.flatnonzero(last)
        #: words from here to the end of the piece
        self.left = after[np.searchsorted(after, np.arange(n))] - np.arange(n) + 1
        self.word = word_names(raw, self.start, self.end)
        lang = np.array([_lang_name(x) for x in langs], dtype=U64)
        self.name = mix(self.word ^ lang[self.row])
        self.level = 1

    def longer(self) -> None:
        """Names phrases of one word more; those that would leave their piece get names that `whole` leaves out."""
        after = np.zeros_like(self.word)
        after[: max(0, len(after) - self.level)] = self.word[self.level :]
        self.name = mix(self.name * LEFT + after)
        self.level += 1

    @property
    def whole(self) -> np.ndarray:
        return self.left >= self.level


def _both(mask: np.ndarray) -> np.ndarray:
    """Whether this and the next place are marked."""
    out = mask.copy()
    out[:-1] &= mask[1:]
    out[-1:] = False
    return out


def buckets(name: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(name.copy(), salt) >> U64(64 - bits)).astype(np.int64) for salt in SALTS]


class Bounds:
    """The bits of a sketch's buckets that reach the least count."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, np.zeros((len(SALTS), 1 << bits >> 3), dtype=np.uint8)

    def __call__(self, name: np.ndarray) -> np.ndarray:
        out = np.ones(len(name), dtype=bool)
        for held, b in zip(self.held, buckets(name, self.bits), strict=True):
            out &= (held[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)
        return out


#: Of a page: the buckets met once, as a list, or as bits where they are many; and the others with their counts.
SKETCH = "row int, page int, once binary, low binary, n binary"
PAGE = 1 << PAGE_BITS


def _once(low: np.ndarray) -> bytes:
    """Distinct places of a page: 2 bytes each, or a bit for every place of the page where that is less."""
    if 16 * len(low) < PAGE:
        return low.tobytes()
    bits = np.zeros(PAGE, dtype=bool)
    bits[low] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _sketch_rows(bits: int, words):
    """Counts of buckets, by pages: of words, or, given the words' bounds, of longer phrases of words that reach them."""

    def emitted(gathered: list[list[np.ndarray]]):
        for row, found in enumerate(gathered):
            b, n = np.unique(np.concatenate(found), return_counts=True)
            page = b >> PAGE_BITS
            at = np.append(np.flatnonzero(np.append(True, page[1:] != page[:-1])), len(b)) if len(b) else [0]
            low, n = (b & ((1 << PAGE_BITS) - 1)).astype(np.uint16), n.astype(np.uint32)
            cuts = list(zip(at[:-1], at[1:], strict=True))
            found.clear()
            one = [n[x:y] == 1 for x, y in cuts]
            yield pa.RecordBatch.from_pydict({
                "row": pa.array([row] * len(cuts), pa.int32()), "page": pa.array([int(page[x]) for x, _ in cuts], pa.int32()),
                "once": pa.array([_once(low[x:y][m]) for (x, y), m in zip(cuts, one, strict=True)], pa.binary()),
                "low": pa.array([low[x:y][~m].tobytes() for (x, y), m in zip(cuts, one, strict=True)], pa.binary()),
                "n": pa.array([n[x:y][~m].tobytes() for (x, y), m in zip(cuts, one, strict=True)], pa.binary()),
            })

    def run(batches):
        gathered: list[list[np.ndarray]] = [[] for _ in SALTS]
        held = 0
        for batch in batches:
            for raw, offsets, langs in _folded(batch):
                p = Phrases(raw, offsets, langs)
                names = [p.name] if words is None else []
                if words is not None:
                    good = last = words.value(p.name)
                    for _ in range(LONGEST - 1):
                        last = np.append(last[1:], False)[: len(good)]
                        good = good & last
                        p.longer()
                        names.append(p.name[good & p.whole])
                for name in names:
                    held += len(name)
                    for found, b in zip(gathered, buckets(name, bits), strict=True):
                        found.append(b)
                if held >= GATHERED:
                    yield from emitted(gathered)
                    held = 0
        if held:
            yield from emitted(gathered)

    return run


def _page_rows(least: int):
    """Of rows sorted by row and page: which buckets of each page reach the least count."""

    def run(batches):
        at, total = None, None

        def done():
            bits = np.packbits(total >= least, bitorder="little")
            return pa.RecordBatch.from_pydict({"row": pa.array([at[0]], pa.int32()), "page": pa.array([at[1]], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

        for batch in batches:
            for row, page, once, low, n in zip(*(batch.column(c).to_pylist() for c in ("row", "page", "once", "low", "n")), strict=True):
                if at != (row, page):
                    if at is not None and total.max() >= least:
                        yield done()
                    at, total = (row, page), np.zeros(PAGE, dtype=np.int64)
                if 8 * len(once) == PAGE:
                    total += np.unpackbits(np.frombuffer(once, dtype=np.uint8), bitorder="little")
                else:
                    total[np.frombuffer(once, dtype=np.uint16)] += 1
                total[np.frombuffer(low, dtype=np.uint16)] += np.frombuffer(n, dtype=np.uint32)  # a page's row has each bucket once
        if at is not None and total.max() >= least:
            yield done()

    return run


def sketch_bounds(texts: DataFrame, bits: int, least: int, words=None):
    """Which buckets reach the least count, broadcast: at most 2 ** MOST_BITS bits a row of the sketch."""
    counted = texts.mapInArrow(_sketch_rows(bits, words), SKETCH)
    pages = counted.repartition("row", "page").sortWithinPartitions("row", "page").mapInArrow(_page_rows(least), "row int, page int, bits binary")
    out = Bounds(bits)
    for r in pages.collect():
        at = r["page"] << PAGE_BITS >> 3
        out.held[r["row"], at : at + len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)
    return texts.sparkSession.sparkContext.broadcast(out)


#: Phrases go to so many buckets by name, so that a task gives a row a bucket and language, not a row a phrase.
BUCKETS = 1024
FOUND = "lang string, bucket int, phrases binary, f binary, n long"


def guarded(text: bytes) -> str:
    """Folded text with one space before and after each word, and piece ends between; a character a byte."""
    text = b" " + text.replace(b"\n", b" \n ") + b" "
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text.decode("latin-1")


def automaton(phrases: list[bytes]) -> ahocorasick.Automaton:
    """Over guarded phrases; gives their places in the list."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        out.add_word(guarded(phrase), i)
    out.make_automaton()
    return out


def _phrase_rows(words, phrases, remembered: int, most_phrases: int, most_texts: int):
    """Phrases whose bounds hold, joined by line feeds, with their overlapping matches in a stretch of the task's texts; and how
    many words each language has (phrases null)."""

    def run(batches):
        seen: set[int] = set()
        n: dict[str, int] = {}
        held: dict[str, tuple[list[bytes], list[int]]] = {}
        texts: dict[str, list[bytes]] = {}
        weight = size = 0

        def given():
            rows: list[tuple] = []
            for lang, (listed, bucket) in held.items():
                compiled, total = automaton(listed), np.zeros(len(listed), dtype=np.int64)
                for part in texts[lang]:
                    found = np.fromiter((i for _, i in compiled.iter(guarded(part))), dtype=np.int64)
                    total += np.bincount(found, minlength=len(listed))
                bucket = np.array(bucket)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)).tolist()
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    rows.append((lang, int(bucket[order[a]]), b"\n".join(listed[i] for i in order[a:b].tolist()), total[order[a:b]].astype(np.uint32).tobytes()))
            held.clear()
            texts.clear()
            seen.clear()
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([r[0] for r in rows], pa.string()), "bucket": pa.array([r[1] for r in rows], pa.int32()),
                "phrases": pa.array([r[2] for r in rows], pa.binary()), "f": pa.array([r[3] for r in rows], pa.binary()), "n": pa.array([None] * len(rows), pa.int64()),
            })

        for batch in batches:
            for raw, offsets, langs in _folded(batch):
                p = Phrases(raw, offsets, langs)
                for row, count in zip(*np.unique(p.row, return_counts=True), strict=True):
                    n[langs[row]] = n.get(langs[row], 0) + int(count)
                text = raw.tobytes()
                by: dict[str, list[bytes]] = {}
                for lang, a, b in zip(langs, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    by.setdefault(lang, []).append(text[a:b])
                for lang, parts in by.items():
                    texts.setdefault(lang, []).append(b"\n".join(parts))
                size += len(text)
                good = words.value(p.name)
                for _ in range(LONGEST):
                    if p.level > 1:
                        good = good & p.whole
                        good[good] = phrases.value(p.name[good])
                    at = np.flatnonzero(good)
                    names, one = np.unique(p.name[at], return_index=True)
                    for name, i in zip(names.tolist(), at[one].tolist(), strict=True):
                        if name not in seen:
                            seen.add(name)
                            k = p.level
                            phrase = b" ".join(text[a:b] for a, b in zip(p.start[i : i + k].tolist(), p.end[i : i + k].tolist(), strict=True))
                            listed, bucket = held.setdefault(langs[p.row[i]], ([], []))
                            listed.append(phrase)
                            bucket.append(name % BUCKETS)
                            weight += len(phrase) + 2
                    if p.level == LONGEST or not len(at):
                        break
                    good = _both(good)
                    p.longer()
                if len(seen) >= remembered or weight >= most_phrases or size >= most_texts:
                    yield given()
                    weight = size = 0
        if held:
            yield given()
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(n), pa.string()), **{c: pa.array([None] * len(n), t) for c, t in (("bucket", pa.int32()), ("phrases", pa.binary()), ("f", pa.binary()))}, "n": pa.array(list(n.values()), pa.int64())})

    return run


def _count_rows(least: int):
    """lang, phrase, f of the phrases that reach the least count, from rows sorted by bucket and language."""

    def run(batches):
        at, held = None, {}

        def given():
            kept = [(x, f) for x, f in held.items() if f >= least]
            return pa.RecordBatch.from_pydict({"lang": pa.array([at[1]] * len(kept), pa.string()), "phrase": pa.array([x.decode(errors="replace") for x, _ in kept], pa.string()), "f": pa.array([f for _, f in kept], pa.int64())})

        for batch in batches:
            for bucket, lang, phrases, f in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "phrases", "f")), strict=True):
                if at != (bucket, lang):
                    if at is not None:
                        yield given()
                    at, held = (bucket, lang), {}
                for phrase, count in zip(phrases.split(b"\n"), np.frombuffer(f, dtype=np.uint32).tolist(), strict=True):
                    held[phrase] = held.get(phrase, 0) + count
        if at is not None:
            yield given()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Written tables: lang, phrase, f of all phrases of 1 to 5 words with f >= least; and lang, n, the words of each language."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(FEWEST_BITS, (size >> 6).bit_length()))
    words = sketch_bounds(texts, bits, least)
    longer = sketch_bounds(texts, bits, least, words)
    found = materialize(texts.mapInArrow(_phrase_rows(words, longer, REMEMBERED, AUTOMATON_BYTES, STRETCH_BYTES), FOUND), "found")
    words.unpersist()
    longer.unpersist()
    totals = materialize(found.where("phrases is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    rows = found.where("phrases is not null").select("bucket", "lang", "phrases", "f").repartition("bucket", "lang").sortWithinPartitions("bucket", "lang")
    return materialize(rows.mapInArrow(_count_rows(least), "lang string, phrase string, f long"), "counts", found), totals


def _inside(words):
    """The phrases of two words and more inside a longer one."""
    lengths = F.sequence(F.lit(2), F.size(words) - 1)
    return F.flatten(F.transform(lengths, lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """The first `most` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are whole; null ones are empty, and rows of null lang are the language `und`. A phrase is 2 to 5 words of one piece,
    at least `least` times in its language; its score is the lowest over its cuts of 1000 * a * n / (l * r), rounded down, by
    decimals of 38 digits. A phrase that stands in a longer one as often as alone is left out. Repeated rows count as often as
    they stand; ties go by count, then by the phrase's bytes. Other columns are ignored; an empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, least)
    words = F.split(F.col("phrase"), " ")
    a = counts.withColumn("words", words).where(F.size("words") > 1).withColumnRenamed("f", "a")
    cut = a.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cut = cut.withColumn("left", F.array_join(F.slice("words", 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " "))
    if totals.count() <= BROADCAST_IDS:
        totals = F.broadcast(totals)
    l, r = (counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])) for side in ("left", "right"))
    cut = cut.join(l, ["lang", "left"]).join(r, ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cut = cut.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)")).withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("up div down"))
    best = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    # of each phrase, the most that a longer one around it has
    longer = a.where(F.size("words") > 2).select("lang", F.explode(_inside(F.col("words"))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("around") < F.lit(INSIDE) * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
