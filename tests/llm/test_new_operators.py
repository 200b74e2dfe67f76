"""Sharding, vector codes and collocations against brute force written apart, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot.llm import collocations, entries, shards, vector_codes

from test_operators import ODD, corpus, frame

# -- sharding -----------------------------------------------------------------------------------------------------------------

MASK = (1 << 64) - 1


def scramble(x, salt=0):
    """The published finaliser, in Python integers."""
    x = (x + (salt + 1) * 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def permuted(x, n, seed):
    bits = max(2, (n - 1).bit_length())
    low, high = bits // 2, bits - bits // 2
    while True:
        widths, left, right = (low, high), x >> high, x & ((1 << high) - 1)
        for r in range(8):
            left, right = right, left ^ (scramble(right ^ scramble(r, seed)) & ((1 << widths[0]) - 1))
            widths = widths[::-1]
        x = left << high | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    for seed in (0, 7):
        p = shards.Permutation(n, seed)
        out = p(np.arange(n))
        assert sorted(out.tolist()) == list(range(n)) and (p.inverse(out) == np.arange(n)).all()
        assert out.tolist() == [permuted(i, n, seed) for i in range(n)]
    if n > 60:
        assert (shards.Permutation(n, 1)(np.arange(n)) != out).any() and (out != np.arange(n)).mean() > 0.9
    wide = shards.Permutation((1 << 45) + n)
    at = np.array([0, n, 1 << 44, (1 << 45) + n - 1])
    assert (wide.inverse(wide(at)) == at).all()


def plan_by_hand(rows, count, seed=0):
    """doc_id, size, crc, shard, slot of rows (doc_id, text) in the order of their ids and texts."""
    n = len(rows)
    out = []
    for i, (doc_id, size, crc) in enumerate(rows):
        at = permuted(i, n, seed)
        out.append((doc_id, size, crc, "rows", at % count, at // count, None))
    return out


@pytest.mark.parametrize("count, parts", [(40, 1), (7, 5), (1, 3)])
def test_shard_plan(spark, count, parts):
    texts = corpus(120, 4) + ODD
    df = frame(spark, texts).withColumn("shard", F.lit("x")).withColumn("number", F.lit(1)).repartition(parts)
    held = sorted((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert sorted(map(tuple, shards.shard_plan(df, count).collect())) == sorted(plan_by_hand(held, count))
    # the same from other partitions, another from another seed
    assert sorted(map(tuple, shards.shard_plan(df.repartition(4), count).collect())) == sorted(plan_by_hand(held, count))
    if count > 1:
        assert sorted(map(tuple, shards.shard_plan(df, count, 5).collect())) == sorted(plan_by_hand(held, count, 5))


def test_shards_of_repeated_and_null_ids(spark):
    rows = [(None, "a"), (None, None), (5, "same"), (5, "same"), (5, "other")] * 40 + [(1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = shards.shard_plan(df, 6).collect()
    assert len(found) == 201 and collections.Counter((r["doc_id"], r["text_crc32"]) for r in found) == collections.Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert shards.shard_plan(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        shards.shard_plan(df, 0)


def test_written_shards(spark, tmp_path):
    df = frame(spark, corpus(50, 2) + ODD)
    path = str(tmp_path / "shards")
    shards.write_shards(df, path, 5, seed=3)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*df.columns, "shard", "slot"} and back.count() == df.count()
    plan = {(r["shard"], r["slot"]): (r["doc_id"], r["text_crc32"]) for r in shards.shard_plan(df, 5, 3).collect()}
    assert {(r["shard"], r["slot"]): (r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in back.collect()} == plan
    # which row stands at a place, from the numbers alone
    ordered = sorted((i, zlib.crc32((t or "").encode())) for i, t in ((r["doc_id"], r["text"]) for r in df.collect()))
    at = list(plan)
    numbers = shards.number_at([a for a, _ in at], [b for _, b in at], len(ordered), 5, 3)
    assert [plan[a][0] for a in at] == [ordered[int(x)][0] for x in numbers]
    assert [tuple(x) for x in zip(*shards.place_of(numbers, len(ordered), 5, 3), strict=True)] == at


# -- vector codes -------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=400, width=16, seed=1, centres=30):
    dice = np.random.default_rng(seed)
    middle = dice.normal(size=(centres, width))
    out = []
    for i in range(n):
        x = (middle[dice.integers(centres)] + 0.2 * dice.normal(size=width)).astype(np.float32)
        out.append((int(i * 7 % 100_003), [float(v) for v in x], int(dice.integers(5)) if i % 9 else None))
    return out


def lloyd(rows, parts=4, entries=256, rounds=4):
    """The contract word by word, in Python integers."""
    rows = sorted(rows, key=lambda r: r[0])
    x = [[int(np.floor(1024 * np.float64(np.float32(v)))) for v in r[1]] for r in rows]
    width = len(x[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def assigned():
        out = []
        for v in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), i) for i, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        at = assigned()
        for p in range(parts):
            by = collections.defaultdict(list)
            for v, a in zip(cut, at, strict=True):
                by[a[p][1]].append(v[p])
            for i, held in by.items():
                books[p][i] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    at = assigned()
    errors = [sum(d for d, _ in a) for a in at]
    labels = collections.Counter()
    for r, e in zip(rows, errors, strict=True):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{i:02x}" for _, i in a), e, labels[r[2]], digest) for r, a, e in zip(rows, at, errors, strict=True))


@pytest.mark.parametrize("n, entries", [(330, 256), (330, 20), (50, 256), (1, 256)])
def test_vector_codes(spark, n, entries):
    rows = vectors(n)
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("clash") for c in ("v", "was", "now", "code", "of", "error")})
    assert sorted(map(tuple, vector_codes.vector_codes(df, entries=entries).collect())) == lloyd(rows, entries=entries)


def test_vector_codes_leave_out(spark):
    rows = vectors(60, 8)
    bad = [(-9, None, 1), (-8, [1.0] * 7 + [None], 1), (-7, [float("nan")] + [0.0] * 7, 1), (-6, [float("inf")] * 8, 1), (-5, [], 1), (-4, [1.0] * 6, 1), (7, [1.0] * 4, 2), (8, [1e18] * 8, 2)]
    found = vector_codes.vector_codes(spark.createDataFrame(rows + bad, VECTORS), entries=16).collect()
    assert sorted(map(tuple, found)) == lloyd(rows, entries=16)
    assert vector_codes.vector_codes(spark.createDataFrame(bad[:6], VECTORS)).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS), entries=257)


def test_vector_codes_of_repeated_rows_and_ties(spark):
    rows = [(i % 10, [float(i % 3)] * 4, None) for i in range(40)] + [(None, [1.0] * 4, 3)]
    found = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS), entries=4).collect()
    assert len(found) == 41 and len({r["codebooks_sha256"] for r in found}) == 1
    # the four first vectors are vec_id 0: components 0, 0, 1, 2 (ten rows have each id's four)
    assert {r["code"] for r in found if r["error"] == 0} <= {"00000000", "02020202", "03030303", "01010101"}
    assert [r["label_error"] for r in found if r["vec_id"] is None] == [0]


def test_codes_stand_for_vectors(spark):
    rows = vectors(300)
    table, books = vector_codes.fit_codebooks(spark.createDataFrame(rows, VECTORS), entries=64)
    coded = vector_codes.encode(table, books)
    known = {r[0]: np.array([np.floor(1024 * np.float64(np.float32(v))) for v in r[1]]) for r in rows}
    for r in vector_codes.decode(coded, books).collect():
        assert ((known[r["vec_id"]] - 1024 * np.array(r["embedding"])) ** 2).sum() == r["error"]
    first, _ = vector_codes.fit_codebooks(spark.createDataFrame(rows, VECTORS), entries=64, rounds=1)
    assert table.agg(F.count("was")).first()[0] == 300 and first.agg(F.count("was")).first()[0] == 0


def test_nearest_is_exact_for_large_components():
    dice = np.random.default_rng(0)
    x, book = dice.integers(-(1 << 27), 1 << 27, (50, 4)), dice.integers(-(1 << 27), 1 << 27, (30, 4))
    book[7] = book[3]
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(book))[1] for v in x]
    assert vector_codes.nearest(x, book).tolist() == want and 7 not in want


# -- collocations -------------------------------------------------------------------------------------------------------------


def phrases_by_hand(rows, least, most=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in good.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items())
            if not inside:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def prose(n=120, seed=9):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Aé", "x y", "I", "日本", "W3", "a\x00b"]
    fixed = ["new york city", "Der  Die\tDas", "x x x", "aé É 日本 w1 w2 w3"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(dice.randint(0, 60)):
            out.append(dice.choice(fixed) if dice.random() < 0.25 else dice.choice(words))
            out.append(dice.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; ", "!?"]))
        rows.append(("".join(out), dice.choice(["en", "en", "en", "de", None, "und", "a\tb\nc"])))
    return rows


LANGS = "doc_id long, text string, lang string"


@pytest.mark.parametrize("least, most, size", [(5, 2000, None), (20, 10, None), (5, 2000, 300)])
def test_collocations(spark, monkeypatch, least, most, size):
    if size:  # several groups of automata, and texts cut at piece ends
        monkeypatch.setattr(collocations, "AUTOMATON_BYTES", size)
        monkeypatch.setattr(collocations, "CHUNK_BYTES", 64)
    rows = prose() + [(None, "en"), ("", None), (" \t\n", "de"), ("word", "en")] * 2 + [("x " * 3000 + ". " + "q r " * 500, "en")]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], LANGS).repartition(5)
    df = df.withColumns({c: F.lit("clash") for c in ("phrase", "n", "f", "id", "words", "bucket", "a")})
    assert sorted(map(tuple, collocations.collocations(df, least, most).collect())) == phrases_by_hand(rows, least, most)


def test_no_collocations(spark):
    none = spark.createDataFrame([], LANGS)
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], LANGS), 2).collect() == []
    # one word alone, however common
    assert collocations.collocations(spark.createDataFrame([(1, "a. " * 200, None)], LANGS)).collect() == []


def test_sketch_bounds_are_never_low(spark, monkeypatch):
    """Even a sketch of far too few buckets loses no phrase."""
    rows = prose(60)
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], LANGS)
    monkeypatch.setattr(collocations, "GATHERED", 50)
    monkeypatch.setattr(collocations, "REMEMBERED", 20)
    assert sorted(map(tuple, collocations.collocations(df, 4).collect())) == phrases_by_hand(rows, 4)


def test_scores_of_large_counts(spark):
    """Products beyond 64 bits, as the score's expression takes them."""
    rows = [(10**15 + 7, 10**16 + 1, 10**15 + 9, 3 * 10**15 + 5), (10**12, 9 * 10**17, 10**12, 10**12)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in "anlr"}
    df = df.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"]).cast("decimal(38,0)")).withColumn("down", (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    assert [r["s"] for r in df.withColumn("s", F.expr("up div down")).collect()] == [1000 * a * n // (left * right) for a, n, left, right in rows]


# -- the registered SQL -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_collocations"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = entries.QUERIES[name](spark, sf)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.sql(f"SELECT {columns} FROM ({entries.SQL[name]})").fetchall(), key=str)


def test_shard_query(spark):
    found = entries.QUERIES["op11_sharding"](spark, "/root/testdata/sf0.001").collect()
    counts = collections.Counter(r["shard"] for r in found)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts.values()) <= 1 and len({(r["shard"], r["slot"]) for r in found}) == len(found)


def test_phrases_are_counted_in_one_pass(spark, monkeypatch):
    """However many automata the phrases need, the texts are read as often."""
    rows = prose() + [("word", "en")] * 9
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], LANGS).repartition(3)
    reads = []
    kind = type(df)
    first = kind.mapInArrow

    def counted(self, *args, **other):
        reads.append("text" in self.columns)
        return first(self, *args, **other)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    for size in (4 << 20, 200):
        monkeypatch.setattr(collocations, "AUTOMATON_BYTES", size)
        reads.clear()
        counts, _ = collocations.phrase_counts(df, 5)
        assert sum(reads) == 3
        held = {(r["lang"], r["phrase"]): r["f"] for r in counts.collect()}
        assert held["en", "word"] == 9
        assert len(held) > 100 and all(f >= 5 for f in held.values())
