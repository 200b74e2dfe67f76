"""Quality by a linear-chain conditional random field over a text's lines.

Each line is good or bad. Its features are binned properties of its own words and bytes and of the lines before and after it;
transitions tie neighbours. The field is trained on labelled documents, whose lines all take the document's label, and
forward-backward gives each line's probability of being good. Their mean, weighted by line length, is the document's quality;
a logistic curve fitted on the same documents makes it a probability of label 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Slices, Words, chunks, id_and_text, mix, small_batches

#: Labelled documents used for training, at most; chosen by a hash of doc_id.
SAMPLE = 3000
THRESHOLD = 0.7
STEPS = 120

#: Edges of the bins of each feature, in the order of line_features().
SHARE = [0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7]
EDGES = [
    SHARE,  # symbols a word
    SHARE,  # upper-case letters among ASCII letters
    SHARE,  # exclamation marks a word
    SHARE,  # upright strokes a word
    SHARE,  # digits among bytes
    [2, 3, 4, 5, 6, 8, 12],  # bytes a word
    [1.5, 3.5, 6.5, 12.5, 25.5, 50.5, 100.5],  # words
    SHARE,  # words that start three words found earlier in the text
    SHARE,  # words found earlier in the line
    SHARE,  # commas and full stops a word
    [0.5],  # the line stood earlier in the text
    SHARE,  # bytes beyond ASCII
]
BINS = 8
N_FEATURES = len(EDGES)
WIDTH = 3 * N_FEATURES * BINS + 3  # own line, line before, line after; constant, first line, last line

KINDS = {"symbol": b"#*$%&<>@^~_=+\\{}[]", "bang": b"!", "stroke": b"|", "digit": b"0123456789", "stop": b".,", "upper": bytes(range(65, 91)), "letter": bytes([*range(65, 91), *range(97, 123)])}


def _table(kind: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[list(kind)] = 1
    return table


TABLES = {k: _table(v) for k, v in KINDS.items()} | {"beyond": (np.arange(256) >= 128).astype(np.int64)}


def _seen(row: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether an equal name stands earlier in the row."""
    key = mix(name ^ mix(row.astype(U64), 9), 8)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def line_features(raw: np.ndarray, offsets: np.ndarray):
    """For each line that has a word: bins of its features, its row, and its words' bytes."""
    words = Words(raw, offsets)
    n = len(words)
    if not n:
        return np.zeros((0, N_FEATURES), dtype=np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.concatenate(([0], np.cumsum(raw == 10)))
    line = breaks[words.start]
    new = np.ones(n, dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (words.row[1:] != words.row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, n))
    size = np.add.reduceat(words.end - words.start, head)
    begin, end = words.start[head], words.end[np.append(head[1:], n) - 1]
    sums = {}
    for kind, table in TABLES.items():
        total = np.concatenate(([0], np.cumsum(table[raw])))
        sums[kind] = total[end] - total[begin]
    row, name = words.row, words.name
    three = np.zeros(n, dtype=bool)
    if n > 2:
        whole = np.flatnonzero(row[2:] == row[:-2])
        slices = Slices(name)
        three[whole] = _seen(row[whole], slices(whole, whole + 3))
    again = np.add.reduceat(three.astype(np.int64), head)
    at_line = np.repeat(np.arange(len(head)), count)
    inside = np.add.reduceat(_seen(at_line, name).astype(np.int64), head)
    lines = Slices(name)(head, np.append(head[1:], n))
    values = [
        sums["symbol"] / count, sums["upper"] / np.maximum(sums["letter"], 1), sums["bang"] / count, sums["stroke"] / count, sums["digit"] / size,
        size / count, count, again / count, inside / count, sums["stop"] / count, _seen(row[head], lines), sums["beyond"] / size,
    ]
    bins = np.stack([np.searchsorted(e, v, side="right") for e, v in zip(EDGES, values, strict=True)], axis=1).astype(np.uint8)
    return bins, row[head], size


def scores(bins: np.ndarray, row: np.ndarray, weights: np.ndarray):
    """Each line's log-odds of good from features alone, and what it used: column numbers, with -1 for none."""
    n = len(bins)
    own = bins.astype(np.int64) + np.arange(N_FEATURES) * BINS
    base = N_FEATURES * BINS
    used = np.full((n, 3 * N_FEATURES + 3), -1, dtype=np.int64)
    used[:, :N_FEATURES] = own
    same = row[1:] == row[:-1]
    used[1:, N_FEATURES : 2 * N_FEATURES] = np.where(same[:, None], own[:-1] + base, -1)
    used[:-1, 2 * N_FEATURES : 3 * N_FEATURES] = np.where(same[:, None], own[1:] + 2 * base, -1)
    used[:, -3] = 3 * base
    used[:, -2] = np.where(np.concatenate(([True], ~same)), 3 * base + 1, -1)
    used[:, -1] = np.where(np.append(~same, True), 3 * base + 2, -1)
    return np.append(weights, 0.0)[used].sum(axis=1), used


def line_odds(bins: np.ndarray, row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The log-odds of scores(), without what they used: a few numbers a line."""
    base = N_FEATURES * BINS
    own, before, after = np.zeros(len(bins)), np.zeros(len(bins)), np.zeros(len(bins))
    for f in range(N_FEATURES):
        at = bins[:, f].astype(np.int64) + f * BINS
        own += weights[at]
        before += weights[at + base]
        after += weights[at + 2 * base]
    same = row[1:] == row[:-1]
    own[1:] += np.where(same, before[:-1], weights[3 * base + 1])
    own[:-1] += np.where(same, after[1:], weights[3 * base + 2])
    if len(own):
        own[0] += weights[3 * base + 1]
        own[-1] += weights[3 * base + 2]
    return own + weights[3 * base]


#: Lines of a segment; a longer text is several, so that its steps grow with the root of its length rather than with it.
SEGMENT = 512


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def forward_backward(odds: np.ndarray, row: np.ndarray, move: np.ndarray):
    """P(good) of each line, and summed P(state, next state) as a 2 x 2 table. move: log transition scores.

    All texts' chains go on side by side. A chain of more than SEGMENT lines is cut: products of its segments' matrices, which
    are made side by side too, give the messages at the cuts, so the result is the same up to rounding.
    """
    n = len(odds)
    heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    length = np.diff(np.append(heads, n))
    parts = -(-length // SEGMENT)
    chain = np.repeat(np.arange(len(heads)), parts)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = heads[chain] + number * SEGMENT
    size = np.minimum(SEGMENT, length[chain] - number * SEGMENT)
    here = np.stack([np.ones(n), np.exp(np.clip(odds, -30, 30))], axis=1)
    step = np.exp(np.clip(move, -20, 20))
    opens = number == 0  # no step leads to a chain's first line
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")  # segments longer than t
    coming, going = np.ones((len(chain), 2)), np.ones((len(chain), 2))  # messages into a segment from before and from behind
    if len(chain) > len(heads):
        whole = np.where(opens[:, None, None], np.eye(2), step) * here[start][:, None, :]
        for t in range(1, SEGMENT):
            at = order[: live[t]]
            whole[at] = _unit(whole[at] @ step * here[start[at] + t][:, None, :])
        last = np.cumsum(parts) - 1
        for k in range(1, int(parts.max())):
            at = np.flatnonzero(number == k)
            coming[at] = _unit((coming[at - 1][:, None, :] @ whole[at - 1])[:, 0])
            at = last[parts > k] - k  # the k-th segment from behind
            going[at] = _unit((whole[at + 1] @ going[at + 1][:, :, None])[:, :, 0])
    ahead, back = np.empty((n, 2)), np.empty((n, 2))
    state = np.where(opens[:, None], coming, coming @ step)[order] * here[start[order]]
    for t in range(SEGMENT):
        at = order[: live[t]]
        if not len(at):
            break
        if t:
            state = (state[: live[t]] @ step) * here[start[at] + t]
        state = _unit(state)
        ahead[start[at] + t] = state
    back[start + size - 1] = going
    for t in range(min(SEGMENT, int(size.max(initial=0))) - 2, -1, -1):
        at = start[order[: live[t + 1]]] + t
        back[at] = _unit((here[at + 1] * back[at + 1]) @ step.T)
    at = np.flatnonzero(row[1:] == row[:-1])
    pairs = np.zeros((2, 2))
    for a in range(0, len(at), 65536):
        one = at[a : a + 65536]
        pairs += _unit(ahead[one][:, :, None] * step[None] * (here[one + 1] * back[one + 1])[:, None, :]).sum(axis=0)
    joint = ahead * back
    return joint[:, 1] / joint.sum(axis=1), pairs


def quality(p: np.ndarray, row: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """Length-weighted mean of P(good) by row; NaN where a row has no line."""
    with np.errstate(invalid="ignore"):
        return np.bincount(row, p * size, rows) / np.bincount(row, size, rows)


def train(bins: np.ndarray, row: np.ndarray, size: np.ndarray, label: np.ndarray, steps: int = STEPS):
    """Weights, transitions and the curve (slope, shift). row: numbers of documents in ascending order; label: of each."""
    weights, move = np.zeros(WIDTH), np.zeros((2, 2))
    state = label[row].astype(float)
    share = np.array([max(1, (label == k).sum()) for k in (0, 1)])
    weight = (len(label) / 2 / share)[label[row]] if len(label) else np.zeros(0)
    same = row[1:] == row[:-1]
    true_pairs = np.zeros((2, 2))
    np.add.at(true_pairs, (state[:-1][same].astype(int), state[1:][same].astype(int)), 1)
    moments = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    _, used = scores(bins, row, weights)
    for t in range(1, steps + 1):
        odds = np.append(weights, 0.0)[used].sum(axis=1)
        p, pairs = forward_backward(odds, row, move)
        slope = np.zeros(WIDTH + 1)
        np.add.at(slope, used, np.broadcast_to(((state - p) * weight)[:, None], used.shape))
        grad = np.append(slope[:-1], (true_pairs - pairs).ravel()) / max(1, len(row)) - 1e-4 * np.append(weights, move.ravel())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        delta = 0.1 * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-6)
        weights, move = weights + delta[:-4], move + delta[-4:].reshape(2, 2)
    p, _ = forward_backward(scores(bins, row, weights)[0], row, move)
    found = quality(p, row, size, len(label))
    have = ~np.isnan(found)
    x, y = _logit(found[have]), label[have].astype(float)
    a, b = 1.0, 0.0
    for _ in range(200):  # the curve, by gradient steps on few numbers
        q = 1 / (1 + np.exp(-(a * x + b)))
        h = q * (1 - q) + 1e-6
        hess = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]])
        step = np.linalg.solve(hess, np.array([((y - q) * x).sum() - (a - 1), (y - q).sum() - b]))
        a, b = a + 0.5 * step[0], b + 0.5 * step[1]
    return weights, move, (float(max(a, 1e-3)), float(b))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def score_texts(raw, offsets, trained) -> np.ndarray:
    """Each text's probability of label 1; 0 for texts without words."""
    weights, move, (a, b) = trained
    rows = len(offsets) - 1
    bins, row, size = line_features(raw, offsets)
    if not len(row):
        return np.zeros(rows)
    p, _ = forward_backward(line_odds(bins, row, weights), row, move)
    found = quality(p, row, size, rows)
    return np.where(np.isnan(found), 0.0, 1 / (1 + np.exp(-(a * _logit(np.nan_to_num(found)) + b))))


def held_out(column="doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A model trained on at most `sample` labelled documents outside the held-out fold; None without both labels."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                bins, row, size = line_features(raw, offsets)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "quality": part.column("quality"),
                    "bins": pa.array([bins[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary()),
                    "size": pa.array([size[a:b].astype(np.int64).tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary()),
                })

    # the sample is bounded by its parameter, so it is broadcast and its line features are gathered
    rows = id_and_text(docs).where("text is not null").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, quality int, bins binary, size binary").collect()
    rows = sorted((r for r in rows if r["bins"]), key=lambda r: (r["doc_id"], bytes(r["bins"])))
    label = np.array([r["quality"] for r in rows], dtype=np.int64)
    if len(set(label.tolist())) < 2:
        return None if not rows else float(label[0])
    size = [np.frombuffer(bytes(r["size"]), dtype=np.int64) for r in rows]
    bins = np.frombuffer(b"".join(bytes(r["bins"]) for r in rows), dtype=np.uint8).reshape(-1, N_FEATURES)
    return train(bins, np.repeat(np.arange(len(rows)), list(map(len, size))), np.concatenate(size), label)


def quality_scores(docs: DataFrame, labels: DataFrame, keep: bool = False, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; with `keep`, the rows of docs whose predicted is 1, unchanged.

    Whole texts are scored. Null and empty texts have score 0. Without labelled documents every text has score 1 (nothing
    speaks against it), and with one label only, that label. Labels of null or other values, and of unknown documents, are
    left aside; of several labels of one document the smaller holds. held_out is false for a null doc_id.
    """
    small_batches(docs.sparkSession)
    trained = fit(docs, labels, sample)

    def score(raw, offsets):
        if isinstance(trained, tuple):
            return score_texts(raw, offsets, trained)
        first = Words(raw, offsets).first
        return np.where(np.diff(first) > 0, 1.0 if trained is None else trained, 0.0)

    def run(batches):
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                found = score(raw, offsets)
                if keep:
                    yield part.filter(pa.array(found >= THRESHOLD))
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    return id_and_text(docs).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
