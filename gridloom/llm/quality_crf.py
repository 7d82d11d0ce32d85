"""Quality rules: base statistics of a text, and a linear-chain conditional random field over its lines.

A line with a word is described by binary features (length, letter case, symbols, end mark, digits, repetition within it and of earlier
lines). The field labels each line content or boilerplate; Viterbi decoding of the whole text gives the labels, and the share of
word characters on content lines decides.

The tables label documents, not lines, so lines are labelled as far as the tables speak. A line is odd if its features together are LIFT times as frequent among lines of
documents of quality 0 as of quality 1 (each document counting once), plain if it is the other way round. Odd lines, and lines that repeat an earlier one of their text, are boilerplate, plain lines content,
in good and bad documents alike; other lines take their document's label, but for those that stand in documents of different texts: their label is unknown.
The weights are learned by gradient ascent on the likelihood of the known labels (forward-backward with the unknown ones summed out, less forward-backward over all labels), over a
bounded sample of labelled documents (``sample_docs``), of each a run of at most ``sample_lines`` lines at a place given by a hash of its id. Which lines stand in different texts is counted over all documents.

Defined results: a null text has no words; a text without words fails the base rules; without labels, or with one class only, the field keeps every
text that passes the base rules; every input row gives one row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
SPACE = " \t\n\x0b\f\r"

SAMPLE_DOCS = 3000
SAMPLE_LINES = 200
LIFT = 3.0
#: Documents added to each class for every combination of features.
SMOOTHING = 0.05
CONTENT_SHARE = 0.5
ROUNDS = 150
RATE = 0.5
RIDGE = 1e-3
FEATURES = 16
#: The feature of a line that repeats an earlier one.
SEEN = 13
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    repeated = 0
    if n > 2:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        counts: dict = {}
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
        if len(counts) < len(grams):
            end = 0
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return n, chars, symbols, again, repeated


def describe(text: str | None) -> tuple[list[int], list[int]]:
    """For each line with a word, its features as bits and its word characters."""
    codes, sizes = [], []
    seen: set[str] = set()
    for line in (text or "").split("\n"):
        data = line.encode()
        words = data.split()
        m = len(words)
        if not m:
            continue
        size = sum(map(len, words))
        upper = len(data) - len(data.translate(None, _UPPER))
        digits = len(data) - len(data.translate(None, _DIGIT))
        marks = sum(map(line.count, SYMBOLS))
        different = len(set(words))
        on = (
            1, m <= 3, 3 < m <= 10, m > 40, 3 * upper > size, 10 * upper > 7 * size, marks > 0, 4 * marks > m,
            words[-1][-1:] in (b".", b"!", b"?"), 3 * data.count(b"!") > m, 5 * digits > size, 2 * different < m,
            5 * different < 4 * m, line in seen, size > 12 * m, size < 3 * m,
        )
        seen.add(line)
        codes.append(sum(1 << k for k, x in enumerate(on) if x))
        sizes.append(size)
    return codes, sizes


def _bits(codes: np.ndarray) -> np.ndarray:
    return (codes[..., None] >> np.arange(FEATURES)) & 1


def known_labels(texts: list[np.ndarray], shared: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """For each text a row by line and label: whether that label is possible. texts: line codes; shared: whether a line stands in other texts; y: 1 for good."""
    weight = np.zeros((2, 1 << FEATURES))
    for c, k in zip(texts, y, strict=True):
        np.add.at(weight[int(k)], c, 1 / len(c))
    rate = (weight + SMOOTHING) / (weight.sum(axis=1, keepdims=True) + SMOOTHING)
    odd, plain = rate[0] >= LIFT * rate[1], rate[1] >= LIFT * rate[0]
    out = []
    for c, s, k in zip(texts, shared, y, strict=True):
        again = (c >> SEEN & 1).astype(bool)
        bad = odd[c] | again
        good = plain[c] & ~again
        rest = ~bad & ~good & ~s
        out.append(np.column_stack([~good & ~(rest & (k == 1)), ~bad & ~(rest & (k == 0))]))
    return out


def _sums(e: list[np.ndarray], pair: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Probabilities of the labels of each place, and of label pairs of neighbouring places; e: scores by place (texts longer than it, label)."""
    most = len(e)
    add = lambda m, axis: np.log(np.exp(m - m.max(axis=axis, keepdims=True)).sum(axis=axis)) + m.max(axis=axis)
    forward = [e[0]]
    for t in range(1, most):
        forward.append(add(forward[-1][: len(e[t]), :, None] + pair, 1) + e[t])
    back = [np.zeros_like(x) for x in e]
    for t in range(most - 2, -1, -1):
        k = len(e[t + 1])
        back[t][:k] = add(pair + (e[t + 1] + back[t + 1])[:, None, :], 2)
    log_z = add(forward[0] + back[0], 1)
    one = [np.exp(f + b - log_z[: len(f), None]) for f, b in zip(forward, back, strict=True)]
    two = [np.exp(forward[t - 1][: len(e[t]), :, None] + pair + (e[t] + back[t])[:, None, :] - log_z[: len(e[t]), None, None]) for t in range(1, most)]
    return one, two


def train(texts: list[np.ndarray], possible: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS) -> dict | None:
    """texts: line codes of each; possible: as of known_labels; y: 1 for good. Weights of features by label (boilerplate, content) and of label pairs; None if one class is missing."""
    if len(set(y.tolist())) < 2:
        return None
    use = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in use])
    most, n = int(sizes[0]), len(use)
    active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(most)]  # texts longer than t come first
    bits = [_bits(np.array([texts[i][t] for i in use[: active[t]]], dtype=np.int64)).astype(float) for t in range(most)]
    shut = [np.where(np.array([possible[i][t] for i in use[: active[t]]]), 0.0, -1e9) for t in range(most)]
    label = y[use].astype(int)
    weight = (n / (2 * np.bincount(label, minlength=2)))[label] / sizes
    w, pair = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    w[0] = -0.1, 0.1
    speed_w, speed_p = np.zeros_like(w), np.zeros_like(pair)
    total = weight @ sizes
    for _ in range(rounds):
        e = [b @ w for b in bits]
        one, two = _sums(e, pair)
        known, known_two = _sums([x + m for x, m in zip(e, shut, strict=True)], pair)
        g, gp = -RIDGE * total * w, -RIDGE * total * pair
        for t in range(most):
            k = active[t]
            g += bits[t].T @ ((known[t] - one[t]) * weight[:k, None])
            if t:
                gp += ((known_two[t - 1] - two[t - 1]) * weight[:k, None, None]).sum(axis=0)
        speed_w, speed_p = 0.9 * speed_w + g / total, 0.9 * speed_p + gp / total
        w, pair = w + RATE * speed_w, pair + RATE * speed_p
    return {"w": w, "pair": pair}


def viterbi(codes: list[int], model: dict, memo: dict[int, tuple[float, float]]) -> list[int]:
    """Best labels of the lines (1: content); equal paths prefer content."""
    (bb, bc), (cb, cc) = model["pair"].tolist()
    came, b, c = [], 0.0, 0.0
    for t, code in enumerate(codes):
        e = memo.get(code)
        if e is None:
            memo[code] = e = tuple(float(x) for x in _bits(np.array(code)) @ model["w"])
        if t:
            to_b, to_c = c + cb >= b + bb, c + cc >= b + bc
            came.append((to_b, to_c))
            b, c = max(b + bb, c + cb) + e[0], max(b + bc, c + cc) + e[1]
        else:
            b, c = e
    labels = [int(c >= b)] if codes else []
    for step in reversed(came):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


def _line_hashes(text):
    return F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> dict | None:
    """Learns from docs(doc_id, text) with labels(doc_id, quality)."""
    known = labels.where(labels["quality"].isin(0, 1) & labels["doc_id"].isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def run(batches):
        for b in batches:
            out = []
            for t, hashes, at in zip(*(b.column(c).to_pylist() for c in ("text", "hashes", "at")), strict=True):
                codes, _ = describe(t)
                worded = [h for h, line in zip(hashes or [], (t or "").split("\n"), strict=True) if line.strip(SPACE)] if t is not None else []
                first = at % max(1, len(codes) - sample_lines + 1)
                out.append((codes[first : first + sample_lines], worded[first : first + sample_lines]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([c for c, _ in out], pa.list_(pa.int32())), pa.array([h for _, h in out], pa.list_(pa.int64()))], ["doc_id", "y", "c", "h"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # sample_docs rows at most
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y", _line_hashes("text").alias("hashes"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 31)).alias("at"))
    held = Scratch(rows.mapInArrow(run, "doc_id long, y int, c array<int>, h array<long>").dropDuplicates(["doc_id"]), "sample").df
    lines = held.select(F.explode("h").alias("h")).distinct()
    places = docs.where(docs["text"].isNotNull()).select(F.xxhash64("text").alias("th"), F.explode(F.array_distinct(_line_hashes("text"))).alias("h"))
    places = places.join(F.broadcast(lines), "h")  # sample_docs * sample_lines rows at most
    shared = places.groupBy("h").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a != b").select("h").toPandas()["h"].to_numpy()
    t = held.where(F.size("c") > 0).toPandas().sort_values("doc_id")
    if not len(t):
        return None
    texts, y = [np.asarray(c, dtype=np.int64) for c in t["c"]], t["y"].to_numpy()
    return train(texts, known_labels(texts, [np.isin(h, shared) for h in t["h"]], y), y)


def rate(docs: DataFrame, model: dict | None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Base statistics, base_failed, content_share and kept for every row of docs(doc_id, text)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        memo: dict[int, tuple[float, float]] = {}
        for b in batches:
            stats, failed, shares = [], [], []
            for t in b.column(1).to_pylist():
                s = base(t)
                stats.append(s)
                failed.append(s[0] < LEAST_WORDS or 100 * s[4] > MOST_REPEATED * s[0])
                codes, sizes = describe(t)
                if not codes:
                    shares.append(0.0)
                elif model is None:
                    shares.append(1.0)
                else:
                    shares.append(sum(z for z, k in zip(sizes, viterbi(codes, model, memo), strict=True) if k) / sum(sizes))
            kept = [not f and s >= content_share for f, s in zip(failed, shares, strict=True)]
            cols = [pa.array([s[k] for s in stats], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(failed, pa.bool_()), pa.array(shares, pa.float64()), pa.array(kept, pa.bool_())], ["doc_id", *names, "base_failed", "content_share", "kept"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, content_share double, kept boolean"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)


def screen(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return rate(docs, fit(docs, labels, **options))
