"""The corpus pipeline against its stages' brute forces put one after the other, and the queries with SQL against DuckDB."""

import collections
import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_operators import DOCS, classes, windows_removed, words_of

import corpus_pipeline
from weakspot.llm import crf, entries
from weakspot.llm.common import tokenizer_path
from weakspot.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


def failed(text):
    w = words_of(text)
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w) < 10 or 100 * len(inside) > 20 * len(w)


def rejected_hosts(rows):
    """Shrunk failure rates: a beta prior whose mean and weight are fitted to the hosts by moments."""
    hosts = collections.defaultdict(list)
    for r in rows:
        if r["source"] is not None:
            hosts[r["source"]].append(failed(r["text"]))
    n, k = np.array([len(x) for x in hosts.values()], float), np.array([sum(x) for x in hosts.values()], float)
    mean = k.sum() / n.sum()
    room = n.sum() - (n * n).sum() / n.sum()
    between = ((k * k / n).sum() - n.sum() * mean**2 - (len(n) - 1) * mean * (1 - mean)) / room if room else 0
    weight = max(2.0, min(1000.0, mean * (1 - mean) / between - 1)) if between > 0 else 1000.0
    rate = (k + mean * weight) / (n + weight)
    return {h for h, r in zip(hosts, rate) if r > 0.5 and r > 2 * mean}


def corpus():
    dice = random.Random(14)
    vocabulary = ["".join(dice.choice("abcdeilnorst") for _ in range(dice.randint(2, 8))) for _ in range(3000)]
    say = lambda k: [dice.choice(vocabulary) for _ in range(k)]
    passage, texts, labels = say(80), [], []
    for i in range(150):
        words = say(dice.randint(20, 160))
        if i % 6 == 0:
            words[10:10] = passage[dice.randint(0, 9) :]
        text = "\n".join(" ".join(words[a : a + 12]) + "." for a in range(0, len(words), 12))
        good = i % 5 != 0
        if not good:
            text = "\n".join(" ".join(w.upper() + "!!" for w in line.split()) for line in text.split("\n"))
        texts.append(text)
        labels.append((i * 3, int(good), 0))
    near = texts[1].split(" ")
    near[3] = "changed"
    texts += [texts[2], texts[2], " ".join(near), "too short", " ".join(["again and again"] * 40), None, "", " \n", "x " * 3000, "a " + "y" * 30000]
    rows = [(i * 3, t, "en", f"host{i % 7}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(5000 + i, "bad bad bad bad bad bad bad bad bad bad bad bad" if i % 4 else " ".join(say(50)), "en", "poor", 1) for i in range(30)]
    return rows, labels


def test_pipeline(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs, known = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    good = {r["doc_id"] for r in crf.quality_scores(docs, known).collect() if r["predicted"]}
    left = [r.asDict() for r in docs.collect() if r["doc_id"] in good]
    assert 100 < len(left) < len(rows)
    hosts = rejected_hosts(left)
    left = [r for r in left if not failed(r["text"]) and r["source"] not in hosts]
    group = classes({r["doc_id"]: r["text"] for r in left})
    assert any(c[2] != i for i, c in group.items())
    left = [r for r in left if group[r["doc_id"]][2] == r["doc_id"]]
    texts = {r["doc_id"]: r["text"] for r in left}
    removed = windows_removed(texts, 50)
    assert any(n for _, n, _ in removed.values())

    by_doc, by_sequence, library = collections.defaultdict(list), collections.defaultdict(list), Encoder(tokenizer_path("byte_bpe_50k.json")).library
    for r in packed:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    stage = corpus_pipeline.repeated_passages(spark, spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in left], DOCS), "")
    kept = {r["doc_id"]: r["text"] for r in stage.collect()}
    for i, (_, gone, digest) in removed.items():
        assert kept[i] == texts[i] if not gone else hashlib.sha256(kept[i].encode()).hexdigest() == digest
        ids = [*library.encode(kept[i], add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    for places in by_sequence.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 1024


def test_stages_of_nothing_and_of_repeated_rows(spark, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows, _ = corpus()
    for docs in (spark.createDataFrame([], DOCS), spark.createDataFrame([*rows[:9], *rows[:9], (None, "null id, " * 9, None, None, None)], DOCS)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.schema.names == [c.split(" ")[0] for c in DOCS.split(", ")], name
        pieces = corpus_pipeline.packed_sequences(spark, docs, str(tmp_path))
        assert pieces.where("piece = 0").count() == docs.count()


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = entries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    relation = con.sql(entries.SQL[name])
    assert sorted(relation.columns) == columns
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({entries.SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.select(*columns).collect())
