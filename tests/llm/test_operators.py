"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns."""

import collections
import hashlib
import html.parser
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakspot.llm import ball_tree, chosen_path, common, crf, host_rules, html_tree, packing, recompression, sentencepieces, sstable, suffix_sort
from weakspot.llm.common import tokenizer_path
from weakspot.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return WORD.findall(text or "")


def corpus(n=60, seed=3, vocabulary=40):
    """Texts with copies, near copies, shared passages, runs and odd white space."""
    dice = random.Random(seed)
    words = [f"w{i}" + "é" * (i % 5 == 0) for i in range(vocabulary)]
    passage = [dice.choice(words) for _ in range(90)]
    out = []
    for i in range(n):
        kind = dice.random()
        body = [dice.choice(words) for _ in range(dice.randint(0, 150))]
        if kind < 0.3:
            at = dice.randint(0, len(body))
            a = dice.randint(0, 35)
            body[at:at] = passage[a : a + dice.randint(48, 90)]
        elif kind < 0.5 and out:
            body = words_of(dice.choice(out))
            if body and dice.random() < 0.6:
                body[dice.randrange(len(body))] = "other"
        elif kind < 0.6:
            body = ["same"] * dice.randint(40, 130) + body[: dice.randint(0, 20)]
        elif kind < 0.65:
            body = ["ab", "cd"] * dice.randint(20, 70)
        out.append("".join(w + dice.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in body))
    return out


def frame(spark, texts, extra=True):
    rows = [(i * 3 % 1009, t, "en", f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # names that operators use inside
    for name in ("at", "key", "words", "count", "first", "score", "host") if extra else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


ODD = [None, "", " \n\t ", "one", "x " * 30000, "a b c d", "a b c d", "\x0b\x0c", "!", "é" * 600]


def texts_by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


# -- substring dedup ----------------------------------------------------------------------------------------------------------


def windows_removed(texts, window):
    least = {}
    for i in sorted(texts):
        w = words_of(texts[i])
        for k in range(len(w) - window + 1):
            least.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in texts.items():
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    df = frame(spark, corpus(70, seed) + ODD)
    rows = recompression.substring_dedup(df).collect()
    assert {r["doc_id"]: tuple(r)[1:4] for r in rows} == windows_removed(texts_by_id(df), 50)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)


def test_marks_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    df = frame(spark, corpus(40, 6) + ODD)
    assert {r["doc_id"]: tuple(r)[1:4] for r in recompression.substring_dedup(df).collect()} == windows_removed(texts_by_id(df), 50)


def thue_morse(n, a, b):
    """n characters (a power of 2); the word and its complement defeat every polynomial hash modulo a power of 2."""
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_thue_morse_words_differ(spark, n):
    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    fill = [f"w{i}" for i in range(60)]
    texts = [" ".join([*fill[:30], x, *fill[30:]]) for x in (one, two, one)]
    df = frame(spark, texts, extra=False)
    assert [r["n_removed"] for r in sorted(recompression.substring_dedup(df).collect())] == [0, 0, 61]
    found = sorted(tuple(r)[:5] for r in suffix_sort.suffix_dedup(df).collect())
    assert found == bytes_removed([(i, t.encode()) for i, t in texts_by_id(df).items()], 400)
    short = frame(spark, [" ".join(["p", "q", "r", x, "s", "t"]) for x in (one, two, one)], extra=False)
    found = {r["doc_id"]: tuple(r)[1:] for r in chosen_path.jaccard_join(short).collect()}
    assert found == classes(texts_by_id(short))


def test_names_of_slices():
    dice = np.random.default_rng(3)
    values = dice.integers(0, 2, 300).astype(np.uint64)
    slices = common.Slices(values)
    start = dice.integers(0, 250, 4000)
    end = start + dice.integers(0, 50, 4000)
    by = collections.defaultdict(set)
    for a, b, h in zip(start, end, slices(start, end)):
        by[h].add(tuple(values[a:b]))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({x for y in by.values() for x in y})
    raw = dice.integers(97, 99, 3000).astype(np.uint8)
    for n in (8, 9, 16, 100):
        names = common.byte_grams(raw, n)
        content = [raw[i : i + n].tobytes() for i in range(3000 - n + 1)]
        assert len(names) == len(content) and len(set(zip(names.tolist(), content))) == len(set(content)) == len(set(names.tolist()))


def test_rows_of_one_id_keep_their_own_marks(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (5, " ".join(["x"] * 30 + words[20:110])), (5, " ".join(words[100:190] + ["y"] * 40)), (5, "other words only"), (None, " ".join(words)), (None, "null and alone")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    found = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in recompression.substring_dedup(df).collect())
    assert found == [(-1, 3, 0), (-1, 200, 0), (1, 200, 0), (5, 3, 0), (5, 120, 90), (5, 130, 90)]
    key = lambda r: (r[0] is None, *(str(x) for x in r))
    found = sorted((tuple(r)[:5] for r in suffix_sort.suffix_dedup(df).collect()), key=key)
    want = bytes_removed([(-1 if i is None else i, t.encode()) for i, t in rows], 400)
    assert found == sorted(((None if w[0] == -1 else w[0], *w[1:]) for w in want), key=key)


def test_substring_dedup_keeps_columns(spark):
    df = frame(spark, corpus(30, 5) + ODD)
    out = recompression.without_repeats(df)
    assert out.schema == df.schema and out.count() == df.count()
    want = windows_removed(texts_by_id(df), 50)
    for r in out.collect():
        n, removed, digest = want[r["doc_id"]]
        if removed:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == digest and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == texts_by_id(df)[r["doc_id"]]


def test_recompression_is_local(spark):
    """A symbol's decided stretch gives the same symbol wherever it stands."""
    dice = random.Random(0)
    names = np.array([dice.randrange(6) for _ in range(400)], dtype=np.uint64)
    row = np.zeros(400, dtype=np.int64)
    name, _, start, _, low, high = recompression.recompress(names, names, row)
    for k in np.flatnonzero((low >= 0) & (high <= 400))[::7]:
        a, b = low[k], high[k]
        other = np.concatenate((np.array([9, 8], dtype=np.uint64), names[a:b], np.array([7], dtype=np.uint64)))
        n2, _, s2, _, l2, h2 = recompression.recompress(other, other, np.zeros(len(other), dtype=np.int64))
        same = [m for m, s, lo, hi in zip(n2, s2, l2, h2) if s == start[k] - a + 2 and lo >= 2 and hi <= 2 + b - a]
        assert same == [name[k]]


def test_stretches_are_equal_as_their_symbols_are():
    dice = random.Random(8)
    text = " ".join(["abc"[dice.randrange(3)] for _ in range(400)] + ["b"] * 90 + ["a", "b"] * 70 + ["abc"[dice.randrange(3)] for _ in range(200)] * 2)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    words = common.Words(raw, np.array([0, len(raw)]))
    symbols, n = recompression.Symbols(words), len(words)
    assert (np.diff(symbols.low) >= 0).all() and (np.diff(symbols.high) >= 0).all()
    first = np.array([dice.randrange(n - 110) for _ in range(3000)])
    end = first + np.array([dice.choice([1, 2, 3, 5, 9, 50, 51, 99]) for _ in first])
    named = list(zip(*(x.tolist() for x in symbols.names(first, end))))
    content = [tuple(text.split(" ")[a:b]) for a, b in zip(first, end)]
    assert len(set(zip(content, named))) == len(set(content)) == len(set(named)) < 3000


# -- suffix array -------------------------------------------------------------------------------------------------------------


def bytes_removed(rows, length):
    seen = collections.Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [2000, 1])
def test_suffix_dedup(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_sort, "MOST_STRETCHES", most)
    df = frame(spark, corpus(40, 7) + ODD)
    rows = suffix_sort.suffix_dedup(df).collect()
    assert sorted(tuple(r)[:5] for r in rows) == bytes_removed([(i, (t or "").encode()) for i, t in texts_by_id(df).items()], 400)
    for r in rows:
        if r["text"].isascii():
            assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_suffix_dedup_of_a_passage_in_many_contexts(spark, monkeypatch):
    """One gram in more different stretches than a shard takes, and texts longer than a segment."""
    monkeypatch.setattr(suffix_sort, "MOST_STRETCHES", 6)
    dice = random.Random(5)
    say = lambda k: "".join(dice.choice("abcdefgh ") for _ in range(k))
    passage, tail = say(330), say(120)
    texts = [say(dice.randrange(300)) + passage + say(dice.randrange(300)) for _ in range(40)]
    texts += [say(50) + passage + tail + say(9) for _ in range(9)] + [tail[-70:] + passage + say(60), say(20000) + passage + tail, "ab" * 700, "a" * 1500]
    # runs of several lengths and periods: strings of equal grams and different lengths
    texts += ["a" * n for n in (399, 400, 430, 455, 517)] + ["x" + "ab" * n + "y" for n in (200, 215, 241)] + ["abc " * 130, "abc " * 121 + "ab"]
    df = frame(spark, texts, extra=False)
    want = bytes_removed([(i, t.encode()) for i, t in texts_by_id(df).items()], 400)
    assert sum(x[2] for x in want) > 3000
    assert sorted(tuple(r)[:5] for r in suffix_sort.suffix_dedup(df).collect()) == want


def test_suffix_dedup_of_planted_passages(spark):
    """Every copy of a passage of 400 bytes goes, the first one too; one of over 50 words but 399 bytes stays; n_bytes is the input's size."""
    dice = random.Random(11)
    say = lambda k: "".join(dice.choice("abcdefgh ") for _ in range(k))
    words = lambda k: " ".join(dice.choice("abcdefgh") * 6 for _ in range(60))[: k - 1] + "."
    planted, short = words(400), words(399)
    assert min(len(x.split()) for x in (planted, short)) > 50
    texts = [say(900) + x + say(700) for x in (planted, short, "", planted, short, "", planted, "")]
    df = frame(spark, texts, extra=False)
    rows, by_id = sorted(suffix_sort.suffix_dedup(df).collect()), texts_by_id(df)
    assert [r["n_bytes"] for r in rows] == [len(by_id[r["doc_id"]]) for r in rows]
    assert {r["doc_id"]: r["text"] for r in rows} == {i: t.replace(planted, "") for i, t in by_id.items()}
    assert sorted(r["n_removed"] for r in rows) == [0] * 5 + [400] * 3


def test_stretches_of_segments(monkeypatch):
    """A long text taken in segments names the same windows."""
    dice = np.random.default_rng(2)
    raw = dice.integers(97, 100, 9000).astype(np.uint8)
    offsets = np.array([0, 100, 5000, 9000])

    def windows():
        key, one, two, row, first, count, pick = suffix_sort.stretches(raw, offsets)
        return {(r, f + j, k, f + p) for k, r, f, c, p in zip(key, row, first, count, pick) for j in range(c)}

    whole = windows()
    assert len(whole) == 4501 + 3601
    monkeypatch.setattr(suffix_sort, "PLACE_BITS", 11)
    assert {x[:2] for x in windows()} == {x[:2] for x in whole}


def test_two_stage_order():
    dice = np.random.default_rng(1)
    for _ in range(60):
        n, length = int(dice.integers(40, 200)), int(dice.integers(3, 30))
        data = dice.integers(0, dice.integers(2, 6), n).astype(np.uint8)
        starts = np.sort(dice.choice(n - length, size=int(dice.integers(1, n - length + 1)), replace=False))
        order, raw = suffix_sort.two_stage_order(data, starts, length), data.tobytes()
        assert sorted(order.tolist()) == starts.tolist()
        cut = [raw[i : i + length] for i in order]
        assert cut == sorted(cut)
        prefixes = suffix_sort.common_prefixes(data, order, length)
        for k in range(1, len(cut)):
            assert prefixes[k] == next((c for c in range(length) if cut[k - 1][c] != cut[k][c]), length)


# -- n-gram Jaccard join ------------------------------------------------------------------------------------------------------


def classes(texts, n=5, threshold=0.8):
    def grams(t):
        w = words_of(t)
        return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    sets = {i: grams(t) for i, t in texts.items()}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for (a, i), (b, j) in itertools.combinations(first.items(), 2):
        c = len(a & b)
        if c >= threshold * (len(a) + len(b) - c) - 1e-9:
            links[i] += 1
            links[j] += 1
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    copies = collections.Counter(first[s] for s in sets.values() if s)
    return {i: (first[s], copies[first[s]], root(first[s]), links[first[s]]) if s else (i, 1, i, 0) for i, s in sets.items()}


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, small):
    if small:  # every larger bucket is split, and blocks are met in pairs
        for name, value in (("BUCKET", 2), ("WIDE_BLOCK", 3), ("BLOCK", 3), ("DEPTH", 2)):
            monkeypatch.setattr(chosen_path, name, value)
    dice = random.Random(4)
    base = [f"t{k}" for k in range(300)]
    near = []
    for _ in range(14):
        t = list(base)
        for k in dice.sample(range(300), dice.choice([1, 3, 6, 9])):
            t[k] = f"x{dice.random()}"
        near.append(" ".join(t))
    df = frame(spark, corpus(40, 9) + near + near[:3] + ODD)
    found = {r["doc_id"]: tuple(r)[1:] for r in chosen_path.jaccard_join(df).collect()}
    assert found == classes(texts_by_id(df))
    if not small:
        kept = {r["doc_id"] for r in chosen_path.one_of_each_class(df).collect()}
        assert kept == {i for i, c in found.items() if c[2] == i}


def test_runs_reach_the_recall():
    """Paths that pairs at the threshold still share after DEPTH splits, drawn from the roots as they are."""
    dice, t, width, pairs = np.random.default_rng(12), chosen_path.THRESHOLD, chosen_path.WIDTH, 200_000
    equal = dice.random((pairs, width)) < t
    roots = [i for r in range(chosen_path.runs_for(chosen_path.RECALL, t, chosen_path.DEPTH + 1)) for i in chosen_path.places(r, width, t)]
    shared = equal[:, roots].sum(axis=1)
    for _ in range(chosen_path.DEPTH):
        shared = dice.binomial(shared * equal.sum(axis=1), 1 / (t * width))
    missed = (shared == 0) | (equal.sum(axis=1) < chosen_path.least_likeness(t))
    assert missed.mean() <= 1.5 * (1 - chosen_path.RECALL)


# -- quality ------------------------------------------------------------------------------------------------------------------


def quality_tables(spark, n=240):
    dice = random.Random(2)
    say = lambda k: " ".join("".join(dice.choice("abcdeilnorst") for _ in range(dice.randint(2, 8))) for _ in range(k))
    texts, labels = [], []
    for i in range(n):
        lines = [say(dice.randint(5, 20)) + "." for _ in range(dice.randint(2, 9))]
        good = i % 3 != 0
        if not good:
            lines[1:] = [" ".join(w.upper() + "!!" for w in x.split()) if i % 2 else " | ".join(x.split()) for x in lines[1:]]
        texts.append("\n".join(lines))
        labels.append((i * 3 % 1009, int(good), 0))
    return frame(spark, texts + ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = quality_tables(spark)
    out = crf.quality_scores(docs, labels)
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    held = [r["predicted"] == want[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in want]
    assert len(held) > 30 and sum(held) / len(held) > 0.95
    kept = crf.quality_scores(docs, labels, keep=True)
    assert kept.schema == docs.schema and kept.count() == sum(r["predicted"] for r in rows)
    # no labels, or labels of unknown documents only: nothing speaks against a text with words
    none = crf.quality_scores(docs, labels.where("doc_id < 0")).collect()
    assert {r["score"] for r in none} == {0.0, 1.0}


def test_forward_backward_is_exact():
    dice = np.random.default_rng(0)
    odds, row, move = dice.normal(size=7), np.array([0, 0, 0, 0, 1, 1, 2]), dice.normal(size=(2, 2))
    p, pairs = crf.forward_backward(odds, row, move)
    for chain in (range(0, 4), range(4, 6), range(6, 7)):
        total, good = 0.0, np.zeros(7)
        for states in itertools.product((0, 1), repeat=len(chain)):
            v = np.exp(sum(odds[i] * s for i, s in zip(chain, states)) + sum(move[a, b] for a, b in zip(states, states[1:])))
            total += v
            for i, s in zip(chain, states):
                good[i] += v * s
        assert np.allclose(p[list(chain)], good[list(chain)] / total)
    assert np.isclose(pairs.sum(), 4)


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 50])
def test_cut_chains_give_the_same_marginals(monkeypatch, segment):
    dice = np.random.default_rng(1)
    row = np.repeat(np.arange(6), [1, 40, 3, 7, 100, 2])
    odds, move = 3 * dice.normal(size=len(row)), dice.normal(size=(2, 2))
    p, pairs = crf.forward_backward(odds, row, move)
    monkeypatch.setattr(crf, "SEGMENT", segment)
    q, cut = crf.forward_backward(odds, row, move)
    assert np.allclose(p, q, atol=1e-12) and np.allclose(pairs, cut, atol=1e-9)


def test_odds_without_what_they_used():
    dice = np.random.default_rng(2)
    bins, row = dice.integers(0, crf.BINS, (50, crf.N_FEATURES)).astype(np.uint8), np.sort(dice.integers(0, 9, 50))
    weights = dice.normal(size=crf.WIDTH)
    assert np.allclose(crf.line_odds(bins, row, weights), crf.scores(bins, row, weights)[0])
    assert crf.line_odds(bins[:0], row[:0], weights).tolist() == []


def test_long_text_is_scored_in_bounded_time():
    """A million lines; the messages' steps grow with the root of their number."""
    import time
    import tracemalloc

    raw = np.frombuffer(b"some words here\n" * 1_000_000, dtype=np.uint8)
    trained = (np.zeros(crf.WIDTH), np.ones((2, 2)), (1.0, 0.0))
    began = time.perf_counter()
    tracemalloc.start()
    assert 0 <= crf.score_texts(raw, np.array([0, len(raw)]), trained)[0] <= 1
    assert time.perf_counter() - began < 60 and tracemalloc.get_traced_memory()[1] < 1_500_000_000
    tracemalloc.stop()


# -- host rules ---------------------------------------------------------------------------------------------------------------


def test_host_rules(spark):
    df = frame(spark, corpus(50, 11) + [t for t in ODD if t is None or len(t) < 5000])
    found = {r["doc_id"]: r for r in host_rules.host_rules(df).collect()}
    for i, t in texts_by_id(df).items():
        w, t = words_of(t), t or ""
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r["kept"] or not r["base_failed"])
    kept = host_rules.without_failures(df)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}


def test_bad_host_goes(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(i, good if i % 10 else "bad", "en", "fine", 1) for i in range(200)] + [(1000 + i, "bad" if i % 5 else good, "en", "poor", 1) for i in range(100)] + [(5000, good, "en", None, 1)]
    out = {r["doc_id"]: r["kept"] for r in host_rules.host_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert out[1] and not out[0] and not any(out[1000 + i] for i in range(100)) and out[5000]


# -- tokens -------------------------------------------------------------------------------------------------------------------

STRANGE = ["", " ", "a  b", " a ", "a\n\nb", "x<|endoftext|>y", "ß É é", "漢字 12 3.14", "İstanbul ΣΑΣ", "a\tb\x1cc\x85d", "🙂👍🏽 ok", "ño ́x", "it's I'LL", "▁ x▁y", "<0x0A> <s>", "   lead  ", " \n", "a\x00b"]


def strange(n=400):
    dice = random.Random(1)
    return STRANGE + ["".join(dice.choice("aB éÉß\n'sSdD123.,!*́İΣς中\t  🙂<|>▁thein") for _ in range(dice.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_encoding_is_the_librarys(name):
    e = Encoder(tokenizer_path(name))
    assert e.kind
    for t in strange() + corpus(5):
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.library.encode(t, add_special_tokens=False).ids, t


def test_sentencepiece_is_the_librarys(spark):
    m = sentencepieces.Model(tokenizer_path("piece_bpe_32k.model"))
    for t in strange() + corpus(5):
        assert m.encode(t) == m.library.encode(t), t
    df = frame(spark, corpus(5) + ODD)
    for r in sentencepieces.encode_decode(df, tokenizer_path("piece_bpe_32k.model"), outputs=True).collect():
        t = texts_by_id(df)[r["doc_id"]] or ""
        ids = m.library.encode(t)
        assert r["ids"] == ids and r["decoded"] == m.library.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_sstables(spark):
    path = tokenizer_path("word_bpe_49k.json")
    df = frame(spark, corpus(40) + ODD)
    df = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    manifest = sstable.write_sstables(df, path)
    rows = sorted(tuple(r) for r in sstable.read_sstables(manifest).collect())
    library, start, want = Encoder(path).library, 0, []
    for i, t in sorted((r["doc_id"], r["text"] or "") for r in df.collect() if r["doc_id"] is not None):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert rows == want
    assert len(sstable.lookup(manifest, 6)) == dict((w[0], w[2]) for w in want)[6] and sstable.lookup(manifest, 1_000_000) is None
    sstable.remove_sstables(manifest)


def test_packing(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    df = frame(spark, corpus(60) + ODD)
    rows = packing.pack(df, path, 64).collect()
    library, texts = Encoder(path).library, texts_by_id(df)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert r["piece"] == k and r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            assert r["length"] == 64 or k == 0 or len(ids) <= 64
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= total / 64 * 1.05 + 2


def fewest_bins(pieces, capacity):
    """By trying all ways: each piece goes into one of the bins or opens the next."""
    best = [len(pieces)]

    def put(i, spaces):
        if len(spaces) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(spaces)
            return
        for s in set(spaces):
            if s >= pieces[i]:
                rest = list(spaces)
                rest.remove(s)
                put(i + 1, [*rest, s - pieces[i]])
        put(i + 1, [*spaces, capacity - pieces[i]])

    put(0, [])
    return best[0]


def test_evolved_packing_of_small_cases_is_the_best():
    dice, better, worse = random.Random(21), 0, 0
    for case in range(60):
        pieces = sorted((dice.randint(15, 60) for _ in range(dice.randint(6, 10))), reverse=True)
        counts, want = dict(collections.Counter(pieces)), fewest_bins(pieces, 100)
        assert packing.lower_bound(counts, 100) <= want
        solution = packing.evolve(counts, 100, case, [])
        used = collections.Counter()
        for contents, n in solution:
            assert sum(x * k for x, k in contents) <= 100
            for x, k in contents:
                used[x] += n * k
        assert used == counts
        worse += packing.bins(solution) > want
        better += packing.bins(solution) < packing.bins(packing.best_fit(counts, 100))
    assert worse == 0


def test_search_saves_bins_over_best_fit():
    """Pieces of which three always fill a bin: best fit misses many, and the search finds some of them."""
    dice, saved = random.Random(3), 0
    for seed in range(4):
        pieces = []
        for _ in range(40):
            a, b = dice.randint(260, 450), dice.randint(240, 330)
            pieces += [a, b, 1000 - a - b]
        counts = dict(collections.Counter(pieces))
        plain, found = packing.bins(packing.best_fit(counts, 1000)), packing.bins(packing.evolve(counts, 1000, seed, [], generations=200))
        assert packing.lower_bound(counts, 1000) == 40 <= found <= plain
        saved += plain - found
    assert saved > 0


def test_fullest_is_the_best_subset():
    dice = random.Random(9)
    for _ in range(80):
        pieces = [dice.randint(3, 40) for _ in range(dice.randint(1, 9))]
        space = dice.randint(1, 100)
        chosen = packing.fullest(dict(collections.Counter(pieces)), space)
        sums = {sum(c) for n in range(len(pieces) + 1) for c in itertools.combinations(pieces, n)}
        assert sum(x * k for x, k in chosen.items()) == max(x for x in sums if x <= space)
        assert all(k <= pieces.count(x) for x, k in chosen.items())


def test_crossover_and_mutation_keep_all_pieces():
    dice = random.Random(5)
    counts = {x: dice.randint(1, 30) for x in range(1, 100)}
    one, two = packing.best_fit(counts, 100), packing.best_fit(counts, 100, dice)
    for _ in range(10):
        child = packing.mutate(packing.crossover(one, two, counts, 100, dice), 100, dice)
        used = collections.Counter()
        for contents, n in child:
            assert sum(x * k for x, k in contents) <= 100
            for x, k in contents:
                used[x] += n * k
        assert used == counts
        one, two = two, child


# -- top-k search -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD", 40), ("LARGEST_SHARD", 40), ("SAMPLE", 90), ("TOGETHER", 3), ("BLOCK", 5), ("LEAF", 4), ("ROUNDS", ((0, 1), (1, 3), (3, None)))):
            monkeypatch.setattr(ball_tree, name, value)
    dice = np.random.default_rng(2)
    rows = [(i, dice.normal(size=6).round(1).tolist(), 1) for i in range(300)]
    rows += [(400, None, 1), (401, [1.0, None, 0, 0, 0, 0], 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (420, [0.5] * 6, 1), (421, [0.5] * 6, 1), (422, [0.5] * 6, 1)]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in rows], "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash"))
    fine = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in fine if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(fine[q], fine[c])), c) for c in fine if c != q)[:20]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    found = sorted(tuple(r) for r in ball_tree.top_k(df.union(df.where("vec_id = 20"))).collect())
    assert found == want
    few = ball_tree.top_k(df.where("vec_id in (0, 1, 2)")).collect()
    assert len(few) == 2


def test_top_k_of_one_vector_many_times(spark, monkeypatch):
    """A third of all rows are one vector: its part of the tree is dealt to several shards."""
    for name, value in (("SHARD", 30), ("LARGEST_SHARD", 30), ("LEAF", 8)):
        monkeypatch.setattr(ball_tree, name, value)
    dice = np.random.default_rng(4)
    same = dice.normal(size=5).round(1).tolist()
    df = spark.createDataFrame([(i, same if i % 3 == 0 else dice.normal(size=5).round(1).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    v = {r["vec_id"]: [int(np.floor(64 * x)) for x in r["embedding"]] for r in df.collect()}
    want = [(q, k + 1, c, -s) for q in range(0, 400, 20) for k, (s, c) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:20])]
    assert sorted(tuple(r) for r in ball_tree.top_k(df).collect()) == want


def test_top_k_of_large_numbers(spark):
    df = spark.createDataFrame([(i, [float(2**20 * (i % 7)), float(i)]) for i in range(60)], "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in ball_tree.top_k(df, k=5).collect())
    v = {i: (64 * 2**20 * (i % 7), 64 * i) for i in range(60)}
    want = [(q, k + 1, c, -s) for q in (0, 20, 40) for k, (s, c) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5])]
    assert found == want


# -- pages --------------------------------------------------------------------------------------------------------------------


def test_sample_pages_are_read_back():
    weights = html_tree.default_weights()
    pages = html_tree.sample_pages(80, seed=77)
    assert sum(html_tree.main_text(p, weights) == "\n".join(w) for p, w in pages) >= 78


#: Pages written by hand, unlike the training pages, and their main texts.
WRITTEN = [
    ('<article><p>See <a title="the hidden gem of town">the place itself</a>, twice.</p></article>', "See the place itself, twice."),
    ('<article><div class="block hidden md:flex"><p>A paragraph that is shown.</p></div><p>Then another one, with more words.</p></article>', "A paragraph that is shown.\nThen another one, with more words."),
    ("<article><p>One two three four.</p><p hidden>not shown<p>Five six seven eight.</p><p>Nine ten.</p></article>", "One two three four.\nFive six seven eight.\nNine ten."),
    ("<article><h1>List</h1><ul><li style='display:none'>not shown<li>First thing<li>Second thing</ul><p>And the end of it all.</p></article>", "List\nFirst thing\nSecond thing\nAnd the end of it all."),
    ("<article><p>We know that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here.</p><p>And <object>what an object says</object> too.</p></article>", "We know that x=2 holds here.\nAnd what an object says too."),
    ('<html><body><script>if (a) { b = "<!-- not closed"; }</script><article><p>Text after the script.</p><p>More text of the article.</p></article><footer>&copy; someone</footer></body></html>', "Text after the script.\nMore text of the article."),
    ("<article><p>Some <span hidden>of this isn't shown</span> words, <span>others</span> are.</p></article>", "Some words, others are."),
    ('<div class=x1><div><a href=/>Home</a> <a href=/a>About us</a> <a href=/b>Contact</a></div><div class=q7><h2>A long walk by the river</h2><p>It was early in the morning when we set out, and the fog had not yet lifted from the water.</p><p>By noon we had reached the bridge that everyone had told us about, and we sat down to rest for a while.</p></div></div>',
     "A long walk by the river\nIt was early in the morning when we set out, and the fog had not yet lifted from the water.\nBy noon we had reached the bridge that everyone had told us about, and we sat down to rest for a while."),
    ('<body><header><a href="/">The Daily</a><nav><a href="/n">News</a><a href="/s">Sport</a></nav></header><main><h1>Rain expected</h1><p>Heavy rain is expected in the north &amp; west on Tuesday.</p><blockquote>Stay at home if you can.</blockquote><form><label>Mail</label><input name=m><button>Subscribe</button></form></main><section id="comments"><h3>2 comments</h3><div><p>First!</p></div><div><p>I like rain.</p></div></section><aside class="sidebar"><ul><li><a href=/x>Most read</a></li></ul></aside><footer>About</footer></body>',
     "Rain expected\nHeavy rain is expected in the north & west on Tuesday.\nStay at home if you can."),
    ("<head><title>T</title><p>No body tag, <b>but</b> a paragraph that is long enough to be read as one.", "No body tag, but a paragraph that is long enough to be read as one."),
]


@pytest.mark.parametrize("page, text", WRITTEN)
def test_written_pages(page, text):
    assert html_tree.main_text(page, html_tree.default_weights()) == text


LONG = "A paragraph of the article that says a lot about many things, and says all of it at some length. " * 3


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p data-x=it's>First piece of text that we don't know is here and it's long enough to matter.</p>", "First piece of text that we don't know is here and it's long enough to matter."),
        ("<p title='a > b' class=x\"y>A paragraph whose attributes hold an angle and a quote, with words enough.</p>", "A paragraph whose attributes hold an angle and a quote, with words enough."),
        ('<p class="x>A paragraph with a quote that never ends is text all the same, as far as it goes.</p>', "A paragraph with a quote that never ends is text all the same, as far as it goes."),
        ("<!--><p>Text after an empty comment is shown by every browser, and it is long enough.</p><!-- x -->", "Text after an empty comment is shown by every browser, and it is long enough."),
        ("<!---><p>Text after another empty comment is shown by every browser, and it is long enough.</p>", "Text after another empty comment is shown by every browser, and it is long enough."),
        ("<!-- x --!><p>Text after a comment that ends with a bang is shown by every browser, too.</p>", "Text after a comment that ends with a bang is shown by every browser, too."),
        ("</><p>Text after an end tag without a name is shown by every browser, too, and long.</p></ x>", "Text after an end tag without a name is shown by every browser, too, and long."),
        ("<details><summary>More</summary><p>A long text that belongs to the article though it is folded away at first.</p></details>", "More\nA long text that belongs to the article though it is folded away at first."),
        ('<div class="comments"><p>Nice post!</p><p>I agree with all of it, really.</p></div>', ""),
        ('<section id="comments"><h3>Comments</h3><div class="comment"><p>Great article, thanks for sharing it with us.</p></div></section>', ""),
    ],
)
def test_text_inside_an_article(inside, text):
    page = f"<body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Title of it</h1><p>{LONG}</p>{inside}<p>{LONG}</p></article><footer>&copy; me</footer></body>"
    assert html_tree.main_text(page, html_tree.default_weights()) == "\n".join(x for x in ("Title of it", LONG.strip(), text, LONG.strip()) if x)


class Article(html.parser.HTMLParser):
    """Another parser: words inside article elements."""

    def __init__(self):
        super().__init__()
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.words += data.split()


def test_pages_of_the_table(spark):
    """Words of the given pages' articles, as another parser finds them."""
    weights, hit, wanted, found = html_tree.default_weights(), 0, 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        apart = Article()
        apart.feed(r["html"] or "")
        one, two = collections.Counter(apart.words), collections.Counter(html_tree.main_text(r["html"] or "", weights).split())
        hit, wanted, found = hit + (one & two).total(), wanted + one.total(), found + two.total()
    assert hit / wanted > 0.995 and hit / found > 0.995


def test_plain_pages_are_mostly_read_back():
    """Pages whose names say little: the words of the main text, by links, lengths and places."""
    weights, hit, wanted, found = html_tree.default_weights(), 0, 0, 0
    for page, texts in html_tree.sample_pages(60, seed=78, plain=0.6):
        one, two = (collections.Counter(x.split()) for x in (" ".join(texts), html_tree.main_text(page, weights)))
        hit, wanted, found = hit + (one & two).total(), wanted + one.total(), found + two.total()
    assert hit / wanted > 0.9 and hit / found > 0.9


def test_marginals_are_exact():
    page, _ = html_tree.sample_pages(1, seed=5)[0]
    nodes = html_tree.parse("<body><nav><ul><li><a>x</a></li></ul></nav><article><h1>t</h1><p>b</p></article></body>")
    html_tree.describe(nodes)
    weights = html_tree.default_weights()
    p, _ = html_tree.marginals(nodes, weights)
    total, good = 0.0, np.zeros(len(nodes))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        v = sum(y * sum(weights.get(f, 0.0) for f in n.features) for n, y in zip(nodes, labels))
        v += sum(weights.get((n.edge, labels[n.parent.place], y), 0.0) for n, y in zip(nodes, labels) if n.parent is not None)
        total += np.exp(v)
        good += np.exp(v) * np.array(labels)
    assert np.allclose(p, good / total)


def test_extract(spark):
    body = "<p>First &amp; <b>bold</b>\n text.<br>More<p>Second&nbsp;one<table><tr><td>c1<td>c2</table>"
    pages = [
        (1, "u", f"<html><head><title>T</title><script>var x='</p>'</script></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1>{body}</article><footer>&copy; x</footer></body></html>"),
        (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed <b>text"), (5, "u", "plain words only"), (6, "u", "<<<>>> & < p"), (None, "u", "<div><p>x</p></div>"), (1, "u", None), (7, "u", "<div>" * 3000 + "deep"),
    ]
    rows = html_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert rows[0]["text"] == "Head\nFirst & bold text. More\nSecond one\nc1\nc2"
    assert rows[1]["text"] == rows[2]["text"] == ""


# -- empty tables -------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).where("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        recompression.substring_dedup(docs), recompression.without_repeats(docs), suffix_sort.suffix_dedup(docs), chosen_path.jaccard_join(docs), chosen_path.one_of_each_class(docs),
        crf.quality_scores(docs, labels), crf.quality_scores(docs, labels, keep=True), host_rules.host_rules(docs), host_rules.without_failures(docs), html_tree.extract(pages), ball_tree.top_k(vectors),
        sstable.read_sstables(sstable.write_sstables(docs, tokenizer_path("word_bpe_49k.json"))), packing.pack(docs, tokenizer_path("byte_bpe_50k.json")), sentencepieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model")),
    ):
        assert out.count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = frame(spark, corpus(12, 13))
    docs = rows.union(rows.where("doc_id in (0, 3)")).union(rows.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    n = docs.count()
    for out in (recompression.substring_dedup(docs), recompression.without_repeats(docs), suffix_sort.suffix_dedup(docs), chosen_path.jaccard_join(docs), host_rules.host_rules(docs), sentencepieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))):
        assert out.count() == n
    assert packing.pack(docs, tokenizer_path("byte_bpe_50k.json")).where("piece = 0").count() == n
