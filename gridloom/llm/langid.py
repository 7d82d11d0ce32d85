"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over all its segmentations
of the product of their pieces' probabilities (forward algorithm); a text's is the product over its words (runs of letters, lower case, with
a space in front). Probabilities are learned by expectation maximisation (forward-backward counts) on the words of
all labelled documents, counted by language first; texts are scored whole. The forward sums of new words run side by side in numpy, some thousands at a time.

Defined results: null texts and texts without a letter are ``und`` with score 0; documents with null lang teach nothing; a letter run is
cut every 24 letters; without any labelled document every text is ``und``; every input row gives one row; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import pieces
from gridloom.llm.common import Scratch, byte_ends, parts

UNDETERMINED = "und"
ROUNDS = 2
#: Probability of a character that no piece holds, and added count of a piece.
UNKNOWN = 1e-8
ADDED = 0.05
#: Words whose sums a worker holds before it starts anew, words whose segmentations are summed side by side, and bytes of text scored at once.
HELD_WORDS = 250_000
LATTICE_WORDS = 8_000
PART = 1_000_000
#: Calibration of what a learned language's text looks like: lengths of the windows in words (powers of 2), nats a letter to which their fit is rounded, least number of them, deviations
#: below the median that are still taken, least deviation in nats a letter, and nats that a whole text must fall short by, so that a few words never suffice.
WINDOWS = 9
STEP = 0.001
LEAST_WINDOWS = 5
DEVIATIONS = 10.0
LEAST_DEVIATION = 0.1
EVIDENCE = 30.0
#: Word characters that are neither letters nor decimal digits. Runs of letters here are those of \p{L} in the JVM.
_OTHERS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and unicodedata.category(c)[0] != "L" and unicodedata.category(c) != "Nd")
_LETTERS = re.compile(r"[^\W\d_]{1,24}")
_APART = {ord(c): " " for c in _OTHERS}


def letter_runs(text: str) -> list[str]:
    """Runs of letters, cut every 24."""
    if not text.isascii() and not _OTHERS.isdisjoint(text):
        text = text.translate(_APART)
    return _LETTERS.findall(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Trie:
    """Pieces by their beginnings, as arrays: many strings are followed at once."""

    def __init__(self, ids: dict[str, int]):
        letters = sorted({c for p in ids for c in p})
        self.codes = np.zeros(0x110000, dtype=np.int64)  # 0: in no piece
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        code = dict(zip(letters, range(1, len(letters) + 1), strict=True))
        nodes, keys = {"": 0}, []
        for p in ids:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    keys.append(nodes[p[: k - 1]] * self.width + code[p[k - 1]])
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.nodes = np.append(order + 1, -1)
        self.first = np.full(self.width, -1)
        self.first[self.keys[self.keys < self.width]] = self.nodes[self.keys < self.width]
        self.piece = np.full(len(nodes) + 1, -1)  # the last one: of no node
        for p, i in ids.items():
            self.piece[nodes[p]] = i

    def next(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes that follow; -1 for none."""
        key = node * self.width + code
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.nodes[at], -1)


class Lattice:
    """All segmentations of a list of words: edges (start, stop, piece) between cells, the places in each word, numbered by place and then by word."""

    def __init__(self, words: list[str], ids: dict[str, int] | Trie, longest: int, unknown: int):
        trie = Trie(ids) if isinstance(ids, dict) else ids
        n = self.n = len(words)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
        m = self.most = int(size.max()) if n else 0
        grid = np.zeros((n, m), dtype=np.int64)
        grid[np.arange(m) < size[:, None]] = trie.codes[np.frombuffer("".join([" " + w for w in words]).encode("utf-32-le"), dtype="<u4")]
        grid = np.ascontiguousarray(grid.T)
        self.first = np.arange(n)
        self.last = size * n + self.first
        self.cells = (m + 1) * n
        #: By place and length: the words that hold a piece there, each once, and the pieces.
        self.edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for i in range(m):
            here = np.flatnonzero(size > i)
            node = trie.first[grid[i, here]]
            piece = trie.piece[node]
            self.edges[i, 1] = here, np.where(piece >= 0, piece, unknown)
            for length in range(2, min(longest, m - i) + 1):
                here, node = here[node >= 0], node[node >= 0]
                node = trie.next(node, grid[i + length - 1, here])
                piece = trie.piece[node]
                if not len(here):
                    break
                if (piece >= 0).any():
                    self.edges[i, length] = here[piece >= 0], piece[piece >= 0]
        self.lengths = range(min(longest, m), 0, -1)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: piece by language; the probability of every prefix."""
        a = np.zeros((self.most + 1, self.n, p.shape[1]))
        a[0] = 1
        for j in range(1, self.most + 1):
            for k in self.lengths:
                if (e := self.edges.get((j - k, k))) is not None:
                    a[j, e[0]] += a[j - k, e[0]] * p[e[1]]
        return a.reshape(-1, p.shape[1])

    def backward(self, p: np.ndarray) -> np.ndarray:
        b = np.zeros((self.cells, p.shape[1]))
        b[self.last] = 1
        b = b.reshape(self.most + 1, self.n, p.shape[1])
        for i in reversed(range(self.most)):
            for k in self.lengths:
                if (e := self.edges.get((i, k))) is not None:
                    b[i, e[0]] += b[i + k, e[0]] * p[e[1]]
        return b.reshape(-1, p.shape[1])

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words of the given weights; p, weight, result: by language."""
        a, b = (x.reshape(self.most + 1, self.n, -1) for x in (self.forward(p), self.backward(p)))
        weight = weight / np.maximum(b[0], 1e-300)
        total = np.zeros(p.shape)
        pieces_, shares = [], []
        for (i, k), (at, piece) in self.edges.items():
            pieces_.append(piece)
            shares.append(a[i, at] * p[piece] * b[i + k, at] * weight[at])
        if pieces_:
            piece, share = np.concatenate(pieces_), np.concatenate(shares)
            for k in range(p.shape[1]):
                total[:, k] = np.bincount(piece, share[:, k], minlength=len(p))
        return total


def vocabulary(path: str = pieces.MODEL) -> tuple[dict[str, int], int]:
    """Pieces of letters with at most one space in front, numbered anew by rank, and the longest one's length."""
    held = pieces.load(path)
    use = [p for p in sorted(held.ids, key=held.ids.get) if re.fullmatch(r" ?[^\W\d_]*", p) and p == p.lower()]
    return {p: i for i, p in enumerate(use)}, max(map(len, use))


def fit(docs: DataFrame, path: str = pieces.MODEL, rounds: int = ROUNDS) -> dict:
    """Learns from all docs(doc_id, text, lang) with text and lang. Returns languages, log priors and piece probabilities (numpy)."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    langs, n = sorted(counts), sum(counts.values())
    ids, longest = vocabulary(path)
    v = len(ids)
    rank = np.arange(v)
    p = np.repeat((1 / (rank + 10.0))[:, None], max(1, len(langs)), axis=1)
    p = np.vstack([p / p.sum(axis=0), np.full((1, p.shape[1]), UNKNOWN)])
    trie = Trie(ids)
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{1,24}"), F.lit(0)))
    held = Scratch(docs.select("lang", words.alias("word")).groupBy("word", "lang").agg(F.count("*").alias("n")).select("word", "lang", "n"), "words")
    for _ in range(rounds if langs else 0):
        handle = docs.sparkSession.sparkContext.broadcast((trie, p))  # sized by the vocabulary and the languages

        def expect(batches, handle=handle):
            trie, now = handle.value
            total = np.zeros((v + 1, len(langs)))
            place = {k: i for i, k in enumerate(langs)}
            for whole in batches:
                for at in range(0, whole.num_rows, LATTICE_WORDS):
                    batch = whole.slice(at, LATTICE_WORDS)
                    found: dict[str, int] = {}
                    row = np.array([found.setdefault(w, len(found)) for w in batch.column(0).to_pylist()], dtype=np.int64)
                    weight = np.zeros((len(found), len(langs)))
                    np.add.at(weight, (row, np.array([place[k] for k in batch.column(1).to_pylist()], dtype=np.int64)), batch.column(2).to_numpy())
                    total += Lattice(list(found), trie, longest, v).expected(now, weight)
            piece, lang = np.nonzero(total[:v])
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        sums = held.df.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        t = sums.toPandas()
        got = np.zeros((v, len(langs)))
        got[t["piece"].to_numpy(), t["lang"].to_numpy()] = t["n"].to_numpy()
        got += ADDED
        p = np.vstack([got / got.sum(axis=0), np.full((1, len(langs)), UNKNOWN)])
    held.drop()
    return {"langs": langs, "prior": np.log(np.array([counts[k] / n for k in langs])) if langs else np.array([]), "p": p, "ids": ids, "longest": longest}


class _Numbers(dict):
    """Words to numbers; new ones get the next and are noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Scorer:
    """Log probabilities of words by language, held while they recur."""

    def __init__(self, trie: Trie, p: np.ndarray, longest: int):
        self.trie, self.p, self.longest = trie, p, longest
        self.numbers, self.logs = _Numbers(), np.zeros((0, p.shape[1] + 1))

    def numbered(self, runs: list[list[str]]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each run of words as rows of the table, and the table: log probability by language, then letters."""
        if len(self.numbers) > HELD_WORDS:
            self.numbers, self.logs = _Numbers(), self.logs[:0]
        get = self.numbers.__getitem__
        rows = [np.fromiter(map(get, words), dtype=np.int64, count=len(words)) for words in runs]
        fresh, found = self.numbers.fresh, [self.logs]
        for at in range(0, len(fresh), LATTICE_WORDS):
            some = fresh[at : at + LATTICE_WORDS]
            lattice = Lattice(some, self.trie, self.longest, len(self.p) - 1)
            found.append(np.column_stack([np.log(np.maximum(lattice.forward(self.p)[lattice.last], 1e-300)), np.fromiter(map(len, some), dtype=np.float64, count=len(some))]))
        if fresh:
            self.numbers.fresh, self.logs = [], np.concatenate(found)
        return rows, self.logs

    def sums(self, runs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each run of words by language, and its letters."""
        rows, logs = self.numbered(runs)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        out = np.zeros((len(rows), logs.shape[1]))
        if sizes.any():
            out[sizes > 0] = np.add.reduceat(logs[np.concatenate(rows)], (np.cumsum(sizes) - sizes)[sizes > 0])
        return out[:, :-1], out[:, -1].astype(np.int64)


def predict(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",), bounds: dict | None = None) -> DataFrame:
    """The carried columns, lang_pred and score for every row of docs(text, ...); with bounds, also n_words, n_letters, fit (log probability
    under lang_pred in nats a letter) and learned: whether the text is like those of that language (see ``unlike``)."""
    langs, prior, p, ids, longest = (model[k] for k in ("langs", "prior", "p", "ids", "longest"))
    handle = docs.sparkSession.sparkContext.broadcast((Trie(ids), p.astype(np.float64)))  # sized by the vocabulary and the languages

    def run(batches):
        scorer = Scorer(*handle.value, longest)
        for b in parts(batches, lambda b: byte_ends(b.column("scored_text")), PART):
            lettered = b.column("scored_lettered").to_pylist()
            runs = [letter_runs(t.lower()) if ok else [] for t, ok in zip(b.column("scored_text").to_pylist(), lettered, strict=True)]
            own, letters = scorer.sums(runs)
            sizes = np.array([len(r) for r in runs], dtype=np.int64)
            names, scores, fits = [UNDETERMINED] * len(runs), np.zeros(len(runs)), np.zeros(len(runs))
            told = np.flatnonzero(sizes > 0) if langs else []
            if len(told):
                total = prior + own[told]
                best = total.argmax(axis=1)
                scores[told] = 1 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
                fits[told] = own[told, best] / letters[told]
                for at, k in zip(told.tolist(), best.tolist(), strict=True):
                    names[at] = langs[k]
            more = []
            if bounds is not None:
                learned = [k != UNDETERMINED and not unlike(bounds, k, *x) for k, *x in zip(names, sizes.tolist(), letters.tolist(), fits.tolist(), strict=True)]
                more = [pa.array(sizes), pa.array(letters), pa.array(fits), pa.array(learned, pa.bool_())]
            carried = [b.column("scored_text" if c == "text" else c) for c in carry]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(names, pa.string()), pa.array(scores), *more], [*carry, "lang_pred", "score", *(DETAILS if more else ())])

    # The text goes to the workers once, whether it is carried or not.
    rows = docs.select(docs["text"].rlike(r"\p{L}").alias("scored_lettered"), docs["text"].alias("scored_text"), *[docs[c] for c in carry if c != "text"])
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    detail = ", n_words long, n_letters long, fit double, learned boolean" if bounds is not None else ""
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double{detail}")


DETAILS = ("n_words", "n_letters", "fit", "learned")


def window(n_words: int) -> int:
    """Number of the longest window of words that a text of so many fills."""
    return min(WINDOWS, n_words.bit_length()) - 1


def unlike(bounds: dict, lang: str, n_words: int, n_letters: int, fit: float) -> bool:
    """Whether a text is far less probable under lang than learned text of its length, or of the next shorter one calibrated. A language without calibration rejects nothing."""
    held = next(((lang, k) for k in range(window(n_words), -1, -1) if (lang, k) in bounds), None)
    if held is None:
        return False
    middle, deviation = bounds[held]
    short = middle - fit
    return short > DEVIATIONS * deviation and short * n_letters > EVIDENCE


def middle_of(values: np.ndarray, counts: np.ndarray) -> float:
    """The median of values that stand so many times."""
    order = np.argsort(values)
    ends = np.cumsum(counts[order])
    low, high = (values[order][np.searchsorted(ends, k, side="right")] for k in ((ends[-1] - 1) // 2, ends[-1] // 2))
    return float(low + high) / 2


def calibrate(docs: DataFrame, model: dict) -> dict:
    """(language, window) to median and deviation (median absolute one, scaled) of the fit of the first 1, 2, 4, ... words of all labelled documents.

    Fits are counted in steps of STEP, so what the driver gets is bounded by the range of fits. Medians hold as long as most documents with a label are in that language."""
    langs, prior, p, ids, longest = (model[k] for k in ("langs", "prior", "p", "ids", "longest"))
    handle = docs.sparkSession.sparkContext.broadcast((Trie(ids), p.astype(np.float64)))  # sized by the vocabulary and the languages

    def run(batches):
        scorer = Scorer(*handle.value, longest)
        place = {k: i for i, k in enumerate(langs)}
        seen: dict[tuple[int, int, int], int] = {}
        for b in parts(batches, lambda b: byte_ends(b.column(0)), PART):
            rows, logs = scorer.numbered([letter_runs(t.lower())[: 1 << (WINDOWS - 1)] for t in b.column(0).to_pylist()])
            for row, lang in zip(rows, b.column(1).to_pylist(), strict=True):
                if not len(row):
                    continue
                ends = (1 << np.arange(window(len(row)) + 1)) - 1
                sums, k = np.cumsum(logs[row], axis=0)[ends], place[lang]
                fits = np.rint(sums[:, k] / sums[:, -1] / STEP).astype(np.int64).tolist()
                for w in np.flatnonzero((prior + sums[:, :-1]).argmax(axis=1) == k).tolist():
                    key = k, w, fits[w]
                    seen[key] = seen.get(key, 0) + 1
        rows = np.array([(*k, n) for k, n in seen.items()], dtype=np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in range(4)], ["lang", "w", "step", "n"])

    taught = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    t = taught.mapInArrow(run, "lang long, w long, step long, n long").groupBy("lang", "w", "step").agg(F.sum("n").alias("n")).toPandas()
    bounds = {}
    for (lang, w), x in t.groupby(["lang", "w"]):
        fit, n = x["step"].to_numpy() * STEP, x["n"].to_numpy()
        if n.sum() >= LEAST_WINDOWS:
            middle = middle_of(fit, n)
            bounds[langs[lang], int(w)] = (middle, max(LEAST_DEVIATION, 1.4826 * middle_of(np.abs(fit - middle), n)))
    return bounds


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs(doc_id, text, lang); learns from what is not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), **options)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
