"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding finds the segmentation of a text into pieces of a public model file whose scores sum highest (the unigram objective over
the file's own pieces and scores, byte pieces for characters in none). Best sums are products of matrices in the max-plus semiring:

* A text is cut into units at places that no piece can cross; between units the only boundary state is "at the cut", so the product of
  unit matrices is a plain concatenation, and a unit's best path is found once and held while it recurs.
* A giant document is cut into chunks of ``chunk`` characters wherever that falls, each a row of its own. The state at a chunk's border is how far
  the piece that straddles it reaches over (0 to longest - 1 characters). A chunk yields its transfer matrix between border states; the
  matrices of a document are combined by an associative scan; then every chunk is traced back on its own between the two states it was given.

Of segmentations with equal sums the one whose last piece is longest is taken, of those the one whose last but one is, and so on. That holds across chunks, too: with the sums, a chunk
yields the order in which its paths between two states would be preferred, so ids do not depend on the size of chunks (where sums of scores are exact, as for whole numbers). Decoding joins pieces and bytes and drops
the space in front, and gives back the text exactly, white space and characters outside the vocabulary included.

Defined results: null text gives null ids and null text; '' gives no ids; every input row gives one row; further columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import pieces
from gridloom.llm.common import Scratch, byte_ends, parts

CHUNK = 32_768
#: Units that a worker holds in each of two generations, and the longest unit that it holds.
HELD_UNITS = 200_000
HELD_LENGTH = 32
#: Bytes of text encoded, and four times the ids decoded, at once.
PART = 500_000
NEVER = float("-inf")


class _Held(dict):
    """Ids of units as 32-bit integers, found when missing. Held units are in two generations; the older one goes when the newer one is full."""

    def __init__(self, find):
        self.find, self.older = find, {}

    def __missing__(self, u: str) -> bytes:
        ids = self.older.get(u)
        if ids is None:
            ids = self.find(u)
        self.hold(u, ids)
        return ids

    def hold(self, u: str, ids: bytes) -> None:
        if len(u) <= HELD_LENGTH:
            if len(self) >= HELD_UNITS:
                self.older = dict(self)
                self.clear()
            self[u] = ids


class Encoder:
    """Best segmentations over a vocabulary."""

    def __init__(self, vocabulary: pieces.Pieces):
        self.v = vocabulary
        self.units = vocabulary.unit.findall
        self.held = _Held(self.unit)
        self.sums: dict[str, float] = {}
        #: Scores of pieces, and NEVER for what only begins one: the search ends where a string begins none.
        self.score = {p[:k]: NEVER for p in vocabulary.ids for k in range(1, len(p))} | {p: vocabulary.scores[i] for p, i in vocabulary.ids.items()}
        #: The same for what ends one, and ids of pieces as 32-bit integers.
        self.ending = {p[-k:]: NEVER for p in vocabulary.ids for k in range(1, len(p))} | {p: vocabulary.scores[i] for p, i in vocabulary.ids.items()}
        self.coded = {p: array("i", [i]).tobytes() for p, i in vocabulary.ids.items()}

    def best(self, s: str, start: int, stop: int, last: int) -> tuple[list[float], list[int]]:
        """Best sums, and starts of the last piece, for boundaries start..last of s, with piece starts before ``stop``; indexes from start."""
        n, core = last - start, stop - start
        total, came = [NEVER] * (n + 1), [-1] * (n + 1)
        total[0] = 0.0
        get, longest, unknown = self.score.get, self.v.longest, self.v.unknown
        part = s[start:last]
        for i in range(min(n, core)):
            t = total[i]
            if t == NEVER:
                continue
            j, most = i + 1, min(n, i + longest)
            e = get(part[i:j])
            if (e is None or e == NEVER) and t + unknown > total[j]:
                total[j] = t + unknown
                came[j] = i
            while e is not None:
                e += t
                if e > total[j]:
                    total[j] = e
                    came[j] = i
                if j == most:
                    break
                j += 1
                e = get(part[i:j])
        return total, came

    def trace(self, s: str, start: int, came: list[int], end: int) -> list[int]:
        """Ids of the path that ends at boundary ``end`` (from start)."""
        out: list[int] = []
        get = self.v.ids.get
        while end > 0:
            i = came[end]
            part = s[start + i : start + end]
            e = get(part)
            if e is None:
                out.extend(self.v.byte_ids[b] for b in reversed(part.encode()))
            else:
                out.append(e)
            end = i
        return out[::-1]

    def unit(self, u: str) -> bytes:
        """A unit's ids as 32-bit integers."""
        _, came = self.best(u, 0, len(u), len(u))
        return array("i", self.trace(u, 0, came, len(u))).tobytes()

    def paths(self, units: list[str]):
        """The same for each of some short units. What one begins with like the one before it is not searched again."""
        before, total, path = "", [0.0], [b""]
        get, longest, unknown, coded = self.ending.get, self.v.longest, self.v.unknown, self.coded
        for u in units:
            same = 0
            for x, y in zip(before, u):
                if x != y:
                    break
                same += 1
            del total[same + 1 :], path[same + 1 :]
            for j in range(same + 1, len(u) + 1):
                at = i = j - 1
                e = get(u[i:j])
                most = total[i] + (unknown if e is None or e == NEVER else e)
                least = j - longest if j > longest else 0
                while e is not None and i > least:
                    i -= 1
                    e = get(u[i:j])
                    if e is not None and e + total[i] >= most:
                        most, at = e + total[i], i
                total.append(most)
                piece = u[at:j]
                path.append(path[at] + (coded.get(piece) or array("i", [self.v.byte_ids[b] for b in piece.encode()]).tobytes()))
            before = u
            yield path[-1]

    def learn(self, rows: list[list[str]]) -> None:
        """Holds the new units of some rows, found in sorted order."""
        held, older = self.held, self.held.older
        new = sorted(u for u in set().union(*rows) if u not in held and u not in older and len(u) <= HELD_LENGTH)
        for u, ids in zip(new, self.paths(new), strict=True):
            self.held.hold(u, ids)

    def sum_of(self, u: str) -> float:
        """A unit's best sum."""
        t = self.sums.get(u)
        if t is None:
            t = self.best(u, 0, len(u), len(u))[0][-1]
            if len(u) <= HELD_LENGTH:
                if len(self.sums) >= HELD_UNITS:
                    self.sums.clear()
                self.sums[u] = t
        return t

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.array([], dtype=np.int32)
        return np.frombuffer(b"".join(map(self.held.__getitem__, self.units(" " + text))), dtype="<i4")

    @staticmethod
    def places(came: list[int], start: int, end: int) -> list[int]:
        """Starts of the pieces of the path that ends at boundary ``end``, last piece first, then -1: in this order paths of equal sums are preferred."""
        out = []
        while end > 0:
            end = came[end]
            out.append(start + end)
        return [*out, -1]

    def transfer(self, s: str, core: int, entry: int) -> list[tuple[int, int, float, int]]:
        """Finite entries (in, out, sum, rank among the paths to out) of a chunk's matrix. s: the chunk and what follows it, as far as a piece can reach; core: the chunk's
        length; entry: largest border state at its start."""
        reach = min(len(s), core + self.v.longest - 1)
        starts = self._sure(s[:core], entry)
        if not starts:
            found: dict[int, list] = {}
            for a in range(min(entry, core) + 1):
                total, came = self.best(s, a, core, reach)
                for b in range(core, reach + 1):
                    if b >= a and total[b - a] > NEVER:
                        found.setdefault(b - core, []).append((self.places(came, a, b - a), a, total[b - a]))
            return [(a, b, t, rank) for b, paths in found.items() for rank, (_, a, t) in enumerate(sorted(paths))]
        first, last = starts[0], starts[-1]
        middle = sum(map(self.sum_of, self.units(s[first:last])))
        tail, _ = self.best(s, last, core, reach)
        paths = []
        for a in range(entry + 1):
            head, came = self.best(s, a, first, first)
            if head[first - a] > NEVER:
                paths.append((self.places(came, a, first - a), a, head[first - a]))
        return [(a, b - core, t + middle + tail[b - last], rank) for rank, (_, a, t) in enumerate(sorted(paths)) for b in range(core, reach + 1) if tail[b - last] > NEVER]

    def _sure(self, part: str, least: int) -> list[int]:
        """Places in a part, from ``least`` and 1 on, that no piece can cross."""
        return [m.start() for m in self.v.unit.finditer(part) if m.start() >= max(1, least)]

    def between(self, s: str, core: int, state_in: int, state_out: int) -> np.ndarray:
        """Ids of a chunk's best path between two border states."""
        end = core + state_out
        if state_in >= end:
            return np.array([], dtype=np.int32)
        starts = self._sure(s[:core], state_in + 1) or [state_in]
        first, last = starts[0], starts[-1]
        _, came = self.best(s, state_in, first, first)
        head = self.trace(s, state_in, came, first - state_in)
        _, came = self.best(s, last, core, end)
        tail = self.trace(s, last, came, end - last)
        middle = b"".join(map(self.held.__getitem__, self.units(s[first:last])))
        return np.concatenate([np.array(head, dtype="<i4"), np.frombuffer(middle, dtype="<i4"), np.array(tail, dtype="<i4")])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of stacked matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(axis=-2)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of (n, k, k) matrices, in log2(n) rounds of independent products."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = np.stack([product(a, b) for a, b in zip(out[:-step], out[step:], strict=True)])
        step *= 2
    return out


def border_states(matrices: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The state at each of the n + 1 borders of the best path that starts and ends in state 0; of equal sums the least rank."""
    n = len(matrices)
    before = np.vstack([np.where(np.arange(matrices.shape[1]) == 0, 0.0, NEVER)[None], scan(matrices)[:, 0, :]])
    states = np.zeros(n + 1, dtype=np.int64)
    for c in range(n - 1, -1, -1):
        sums = before[c] + matrices[c][:, states[c + 1]]
        states[c] = int(np.argmin(np.where(sums == sums.max(), ranks[c][:, states[c + 1]], len(sums))))
    return states


def _encode_giants(giants: DataFrame, vocabulary: pieces.Pieces, chunk: int) -> DataFrame:
    """(doc_id, text_hash, ids) for documents longer than a chunk."""
    k = vocabulary.longest
    spaced = giants.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.concat(F.lit(" "), "text").alias("s"))
    rows = F.sequence(F.lit(0), F.floor((F.length("s") - 1) / chunk).cast("int"))
    cut = spaced.select("row", "doc_id", "text_hash", F.length("s").alias("n"), F.explode(F.transform(rows, lambda c: F.struct(c.alias("c"), F.substring(F.col("s"), c * chunk + 1, F.lit(chunk + k - 1)).alias("part")))).alias("x"))
    cut = cut.select("row", "doc_id", "text_hash", "x.c", F.least(F.lit(chunk), F.col("n") - F.col("x.c") * chunk).cast("int").alias("core"), "x.part")
    chunks = Scratch(cut.repartition("row", "c"), "chunks").df

    def matrices(batches):
        encoder = Encoder(vocabulary)
        for b in batches:
            rows, cs, cores, parts = (b.column(x).to_pylist() for x in ("row", "c", "core", "part"))
            got = [(r, c, *e) for r, c, core, part in zip(rows, cs, cores, parts, strict=True) for e in encoder.transfer(part, core, k - 1 if c else 0)]
            yield pa.RecordBatch.from_pylist([dict(zip(("row", "c", "i", "o", "t", "rank"), g, strict=True)) for g in got], schema=pa.schema([("row", pa.int64()), ("c", pa.int32()), ("i", pa.int32()), ("o", pa.int32()), ("t", pa.float64()), ("rank", pa.int32())]))

    def combine(t: pa.Table) -> pa.Table:
        c, i, o, s, rank = (t.column(x).to_numpy() for x in ("c", "i", "o", "t", "rank"))
        m = np.full((int(c.max()) + 1, k, k), NEVER)
        m[c, i, o] = s
        ranks = np.full(m.shape, k - 1, dtype=np.int64)
        ranks[c, i, o] = rank
        states = border_states(m, ranks)
        return pa.table({"row": pa.array([t.column("row")[0].as_py()] * len(m), pa.int64()), "c": pa.array(np.arange(len(m)), pa.int32()), "a": pa.array(states[:-1], pa.int32()), "b": pa.array(states[1:], pa.int32())})

    def traced(batches):
        encoder = Encoder(vocabulary)
        for b in batches:
            part = [encoder.between(*x) for x in zip(*(b.column(n).to_pylist() for n in ("part", "core", "a", "b")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("text_hash"), b.column("c"), pa.array(part, pa.list_(pa.int32()))], ["row", "doc_id", "text_hash", "c", "part"])

    states = chunks.select("row", "c", "core", "part").mapInArrow(matrices, "row long, c int, i int, o int, t double, rank int").groupBy("row").applyInArrow(combine, "row long, c int, a int, b int")
    back = chunks.join(states, ["row", "c"]).mapInArrow(traced, "row long, doc_id long, text_hash long, c int, part array<int>")
    ids = back.groupBy("row", "doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("c", "part"))).alias("p"))
    return ids.select("doc_id", "text_hash", F.flatten(F.transform("p", lambda x: x["part"])).alias("ids"))


def _divided(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of the documents shorter than a chunk, and of the rest."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    return docs.where(~giant), docs.where(giant)


def _encoded(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    """Ids of a column of texts; null for a null one."""
    rows = [encoder.units(" " + t) if t else [] for t in texts.to_pylist()]
    encoder.learn(rows)
    ids = [b"".join(map(encoder.held.__getitem__, r)) for r in rows]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32) // 4
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32()), mask=pc.is_null(texts))


def encode(docs: DataFrame, path: str = pieces.MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_hash, ids array<int>) for every row of docs(doc_id, text); text_hash is the text's xxhash64."""
    vocabulary = pieces.load(path)
    small, giants = _divided(docs, chunk)

    def run(batches):
        encoder = Encoder(vocabulary)
        for b in parts(batches, lambda b: byte_ends(b.column(1)), PART):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _encoded(encoder, b.column(1))], ["doc_id", "text_hash", "ids"])

    found = small.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, ids array<int>")
    return found.unionByName(_encode_giants(giants, vocabulary, chunk))


class Decoder:
    """Texts of ids."""

    def __init__(self, vocabulary: pieces.Pieces):
        texts = [p.encode() for p in vocabulary.text()]
        for b, i in enumerate(vocabulary.byte_ids):
            texts[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths

    def joined(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces, without the first one of each row, and where each piece ends. first: each non-empty row's first piece."""
        size, at = self.lengths[ids], self.places[ids]
        size[first] -= 1
        at[first] += 1
        ends = np.cumsum(size)
        return self.blob[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def texts(self, column: pa.ListArray) -> pa.Array:
        cut = column.offsets.to_numpy().astype(np.int64)
        ids = column.values.to_numpy()[cut[0] : cut[-1]]
        cut -= cut[0]
        valid = column.is_valid()
        data, ends = self.joined(ids, cut[:-1][cut[1:] > cut[:-1]])
        stops = np.concatenate([[0], ends])[cut]
        try:
            whole = data.tobytes()
            whole.decode()
            out = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(whole)]).cast(pa.string())
            return pc.if_else(valid, out, pa.scalar(None, pa.string()))
        except UnicodeDecodeError:  # ids that encode would not give
            return pa.array([data[x:y].tobytes().decode(errors="replace") if ok else None for x, y, ok in zip(stops[:-1], stops[1:], valid.to_pylist(), strict=True)], pa.string())


def decode(encoded: DataFrame, path: str = pieces.MODEL) -> DataFrame:
    """encoded(doc_id, text_hash, ids) with ``text``."""
    vocabulary = pieces.load(path)

    def run(batches):
        decoder = Decoder(vocabulary)
        for b in parts(batches, lambda b: np.cumsum(pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)), PART // 4):
            yield pa.RecordBatch.from_arrays([*b.columns, decoder.texts(b.column(2))], ["doc_id", "text_hash", "ids", "text"])

    return encoded.select("doc_id", "text_hash", "ids").mapInArrow(run, "doc_id long, text_hash long, ids array<int>, text string")


def checked(docs: DataFrame, path: str = pieces.MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): what encode gives, and whether decode gives back the text; nulls for a null text.

    A document shorter than a chunk is encoded, decoded and compared by one worker; two in a row would hold twice the memory and send every text once more."""
    vocabulary = pieces.load(path)
    small, giants = _divided(docs, chunk)

    def run(batches):
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for b in parts(batches, lambda b: byte_ends(b.column(1)), PART):
            ids = _encoded(encoder, b.column(1))
            same = pc.equal(decoder.texts(ids), b.column(1).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pc.list_value_length(ids).cast(pa.int64()), ids, same], ["doc_id", "n_ids", "ids", "round_trip"])

    found = small.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")
    both = decode(_encode_giants(giants, vocabulary, chunk), path)
    return found.unionByName(both.select("doc_id", F.array_size("ids").cast("long").alias("n_ids"), "ids", F.when(F.col("ids").isNotNull(), F.xxhash64("text") == F.col("text_hash")).alias("round_trip")))
