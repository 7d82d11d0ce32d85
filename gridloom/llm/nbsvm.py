"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators: byte n-grams of 1 to 3 and n-grams of 1 to 3 word shapes (letter case, symbols, digits, equal to the word before), hashed to a fixed number of
columns. Each column is scaled by its class log-count ratio, rows are brought to length 1, and a linear hinge-loss
model is fitted by dual coordinate descent (class-balanced costs). A logistic curve fitted on a fifth of the sample that neither the ratios nor the model have seen turns margins into
scores (a sample with too few labels for that fits it on all).

Labels come from a bounded sample of labelled documents (``sample_docs``, the first in the order of a hash of doc_id); of longer ones the model learns from ``sample_chars`` characters
at a place given by a hash, so that the driver's memory is bounded; scoring reads whole texts.

Defined results: null texts count as ''; labels other than 0 and 1 teach nothing; of several labels of a doc_id the least counts; with no label, or one class
only, every score is that class's share (0.5 without labels); every input row gives one row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 4000
SAMPLE_CHARS = 20_000
COST = 1.0
EPOCHS = 25
SMOOTHING = 1.0
GRAM_BITS = 17
#: Columns: bytes, byte pairs, hashed byte triples, hashed shape n-grams.
PAIRS = 256
TRIPLES = PAIRS + (1 << 16)
SHAPES = TRIPLES + (1 << GRAM_BITS)
WIDTH = SHAPES + (1 << 12)
#: Symbols that count in a word's shape.
SYMBOLS = b"#*$%&|<>!"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shapes(words: list[bytes]) -> np.ndarray:
    """A small number for each word's shape."""
    out, before = np.zeros(len(words), dtype=np.int64), None
    for i, w in enumerate(words):
        case = 1 if w.isupper() else 2 if w.istitle() else 0
        mark = 1 if w[-1:] in b".,;:" else 2 if w[-1] in SYMBOLS else 0
        out[i] = case + 3 * mark + 9 * (w == before) + 18 * (len(w) == 1)
        before = w
    return out


def columns(text: str | None) -> np.ndarray:
    """The distinct columns of a text's indicators, sorted."""
    data = (text or "").encode()
    a = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    pair = a[:-1] * 256 + a[1:]
    triple = ((pair[:-1] * 256 + a[2:]) * 2654435761 & 0xFFFFFFFF) >> (32 - GRAM_BITS)
    s = shapes(data.split())
    two = s[:-1] * 36 + s[1:]
    three = ((two[:-1] * 36 + s[2:]) * 2654435761 & 0xFFFFFFFF) >> 21
    flags = np.zeros(WIDTH, dtype=bool)
    for part in (a, PAIRS + pair, TRIPLES + triple, SHAPES + s, SHAPES + 64 + two, SHAPES + 2048 + three):
        flags[part] = True
    return np.flatnonzero(flags)


def train(rows: list[np.ndarray], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> dict:
    """rows: sorted columns of each text; y: 0 or 1. Returns weights, the log-count ratios, and the logistic curve."""
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return {"w": None, "share": share}
    aside = np.arange(len(rows)) % 5 == 4
    if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
        aside = np.ones(len(rows), dtype=bool)
    learn = np.flatnonzero(~aside) if not aside.all() else np.arange(len(rows))
    counts = np.full((2, WIDTH), SMOOTHING)
    for i in learn:
        counts[y[i], rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[c] / max(np.linalg.norm(ratio[c]), 1e-9) for c in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    bound = cost * len(y) / (2 * np.bincount(y, minlength=2))[y]
    w, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(learn):
            c, v = rows[i], values[i]
            gradient = sign[i] * (w[c] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), bound[i])  # each row's square is 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[c] += step * v
                bias += step
                alpha[i] = new
    margins = np.array([w[c] @ v + bias for c, v in zip(rows, values, strict=True)])[aside]
    target = y[aside].astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        s = p * (1 - p) + 1e-6
        g = np.array([((p - target) * margins).sum() + 1e-2 * a, (p - target).sum()])
        h = np.array([[(s * margins * margins).sum() + 1e-2, (s * margins).sum()], [(s * margins).sum(), s.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return {"w": w * ratio, "squares": ratio * ratio, "bias": bias, "curve": (float(a), float(b)), "share": share}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict:
    """Learns from docs(doc_id, text) with labels(doc_id, label) that are not held out."""
    known = labels.where(labels[label].isin(0, 1) & labels["doc_id"].isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    sample = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # sample_docs rows at most
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - sample_chars + 1, F.lit(1))) + 1
    rows = rows.withColumn("text", F.substring("text", place.cast("int"), F.lit(sample_chars)))

    def run(batches):
        for b in batches:
            got = pa.array([columns(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), got], ["doc_id", "y", "c"])

    t = rows.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(run, "doc_id long, y int, c array<int>").toPandas()
    t = t.drop_duplicates("doc_id").sort_values("doc_id")
    return train([np.asarray(c, dtype=np.int64) for c in t["c"]], t["y"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text)."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH columns, whatever the input

    def run(batches):
        m = handle.value
        for b in batches:
            texts = b.column(1).to_pylist()
            if m["w"] is None:
                out = np.full(len(texts), m["share"])
            else:
                w, squares, (slope, shift) = m["w"], m["squares"], m["curve"]
                margins = np.empty(len(texts))
                for i, t in enumerate(texts):
                    c = columns(t)
                    margins[i] = w[c].sum() / max(np.sqrt(squares[c].sum()), 1e-9) + m["bias"]
                out = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
