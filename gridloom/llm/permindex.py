"""Approximate nearest neighbours by a permutation index with posting lists.

A vector is represented by the ordered list of its ``prefix`` nearest pivots. A row is posted in the inverted files of its first ``posted`` pivots, and a
query reads only the files of its own first pivots; rows that stand in none of them are never looked at. Rows that a query meets in a file are ranked by
the footrule distance of the two lists (a pivot in one list only counts as if at place ``prefix`` of the other), the nearest ``share`` of a shard's rows that it meets is reranked by the
inner product of the original vectors in double precision, and the best k of all files are merged. A row that stands in two files of a query is met
in the one that comes first in the row's own list.

Largest inner products are nearest neighbours once every row gets one more component that fills its length up to the largest one,
and queries a zero there. Pivots are different rows so extended, a bounded sample in the order of a hash; there are about 4 sqrt(n) of them, and a query reads
``read`` times their square root, so that a query's work grows with the power 3/4 of the table. README has the recall measured against brute force.

Files are dealt to shards of about ``shard_rows`` posted rows. Neighbouring small files share a shard, and a file that is larger (a hot vector, many copies) is
split by row number, so no task holds more than a shard and ``query_rows`` queries; a query travels once to each shard that holds a part of a file it reads.

Every row is indexed. Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another length than the most frequent one (the least, if several); null ids take no part; repeated ids count as separate rows, but a
query never meets rows of its own id, and of queries of one id the least vector asks; equal scores go to the smaller id; further columns are ignored. A query that
meets fewer than k rows, while there are more, gets what it met.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch

K = 20
#: Pivots for each square root of the rows, and most of them.
PIVOTS, MOST_PIVOTS = 4, 1 << 16
PREFIX = 48
POSTED = 2
READ = 8.0
SHARE = 0.35
SHARD_ROWS = 8192
QUERY_ROWS = 8192
#: Leaders by which pivots are ordered, so that neighbours share a shard.
LEADERS = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part; v keeps float components as they are, others are doubles."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def extended(v: np.ndarray, top: float) -> np.ndarray:
    """Rows over the largest length, with the component that fills their length up."""
    x = v / top
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def asking(v: np.ndarray) -> np.ndarray:
    return np.hstack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))])


def lists(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Nearest pivots first; equal distances go to the smaller pivot number (any of them where the list ends)."""
    out = np.empty((len(x), length), dtype=np.int32)
    for at in range(0, len(x), 1024):
        near = -np.round(x[at : at + 1024] @ pivots.T, 12)
        some = np.sort(np.argpartition(near, length - 1, axis=1)[:, :length], axis=1)
        out[at : at + 1024] = np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)
    return out


def sizes(n: int, pivots: int, read: float = READ) -> int:
    """How many files a query reads."""
    return max(1, min(pivots, math.ceil(read * math.sqrt(pivots))))


def footrule_gain(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Row by query: a constant less the footrule distance, halved. places: pivot by query, the pivot's place in the query's list (prefix, if in none); rows: the rows' lists."""
    prefix = rows.shape[1]
    gain = np.zeros((len(rows), places.shape[1]), dtype=np.int16)
    for b in range(prefix):
        gain += np.int16(prefix) - np.maximum(places[rows[:, b]], np.int16(b))
    return gain


def search_shard(q_ids, q, q_lists, ids, x, x_lists, place, *, pivots: int, prefix: int, k: int, share: float, batch: int = 1024):
    """(query, ids, scores) of the best k in a shard, best first. place: the place in each row's list of the pivot under which it stands here; x_lists and
    q_lists are the ordered pivots, the queries' as many as the files that they read."""
    pivot = x_lists[np.arange(len(x_lists)), place]
    order = np.lexsort((ids, place, pivot))
    ids, x, x_lists, place, pivot = ids[order], x[order], x_lists[order], place[order], pivot[order]
    cuts = np.flatnonzero(np.diff(pivot, prepend=-1, append=-1))
    for at in range(0, len(q_ids), batch):
        yield from ((at + j, i, s) for j, i, s in _search(q_ids[at : at + batch], q[at : at + batch], q_lists[at : at + batch], ids, x, x_lists, place, pivot, cuts, pivots, prefix, k, share))


def _search(q_ids, q, q_lists, ids, x, x_lists, place, pivot, cuts, pivots, prefix, k, share):
    n = len(q_ids)
    places = np.full((pivots, n), prefix, dtype=np.int16)
    reads = np.zeros((pivots, n), dtype=bool)
    reads[q_lists, np.arange(n)[:, None]] = True
    for b in range(min(prefix, q_lists.shape[1])):
        places[q_lists[:, b], np.arange(n)] = b
    levels = prefix * (prefix + 1) // 2 + 1
    spread, met = np.zeros(n * levels, dtype=np.int64), []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        w = np.flatnonzero(reads[pivot[a]])
        if len(w):
            gain = footrule_gain(places[:, w], x_lists[a:z, :prefix])
            for b in range(int(place[z - 1])):
                gain[(place[a:z, None] > b) & reads[x_lists[a:z, b]][:, w]] = -1  # met in an earlier file of the row's list
            gain[ids[a:z, None] == q_ids[None, w]] = -1
            cells = gain + w * levels
            spread += np.bincount(cells[gain >= 0], minlength=n * levels)
            met.append((a, z, w, gain))
    # Each query's least gain among its nearest share of the rows met, and k at least.
    above = spread.reshape(n, levels)[:, ::-1].cumsum(axis=1)
    enough = np.maximum(k, np.ceil(share * above[:, -1]))
    least = levels - 1 - np.minimum((above < enough[:, None]).sum(axis=1), levels - 1)
    top, scored = np.full((n, k), -np.inf), []
    for a, z, w, gain in met:
        score = q[w] @ x[a:z].T
        score[(gain < least[w]).T | (gain < 0).T] = -np.inf
        both = np.concatenate([top[w], score], axis=1)
        top[w] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        scored.append((a, w, score))
    floor = top.min(axis=1)
    floor = np.where(np.isinf(floor), np.finfo(float).min, floor - 1e-9 * np.abs(floor) - 1e-300)
    pairs = []
    for a, w, score in scored:
        j, i = np.nonzero(score >= floor[w, None])
        pairs.append((w[j], i + a))
    if not pairs:
        return
    j, i = (np.concatenate(c) for c in zip(*pairs, strict=True))
    exact = np.concatenate([(x[i[c : c + (1 << 14)]] * q[j[c : c + (1 << 14)]]).sum(axis=1) for c in range(0, max(1, len(i)), 1 << 14)])
    best = np.lexsort((ids[i], -exact, j))
    ends = np.searchsorted(j[best], np.arange(n + 1))
    for who in np.unique(j):
        mine = best[ends[who] : min(ends[who] + k, ends[who + 1])]
        yield who, ids[i[mine]], exact[mine]


def deal(counts: np.ndarray, pivots: np.ndarray, shard_rows: int) -> list[tuple[int, int, int]]:
    """(pivot, first shard, shards) for every file: large files alone in several shards, small neighbouring ones together."""
    leaders = pivots[: min(LEADERS, len(pivots))]
    order = np.lexsort(np.argsort(-(pivots @ leaders.T), axis=1, kind="stable")[:, :3].T[::-1])
    out, shard, held = [], 0, 0
    for p in order:
        n = int(counts[p])
        parts = max(1, math.ceil(n / shard_rows))
        if held and (parts > 1 or held + n > shard_rows):
            shard, held = shard + 1, 0
        out.append((int(p), shard, parts))
        held += n
        if parts > 1:
            shard, held = shard + parts, 0
    return out


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = K, pivots_per_root: float = PIVOTS, prefix: int = PREFIX, posted: int = POSTED, read: float = READ, share: float = SHARE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k nearest found in vectors(vec_id, embedding) for each of queries(vec_id, embedding)."""
    spark = vectors.sparkSession
    base = Scratch(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors").df
    found = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not found:
        none = base.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
        return none.where(F.lit(False))
    d, n, top = found[0]
    base = base.where(F.size("v") == d)
    asked = usable(queries).where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    wanted = min(MOST_PIVOTS, math.ceil(pivots_per_root * math.sqrt(n)))
    mark = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    # Different rows from the lowest hashes: eight for each pivot wanted, so that copies do not use up the sample.
    sample = base.where(mark <= min(1 << 30, math.ceil(8 * wanted / n * (1 << 30)))).groupBy(F.xxhash64("v").alias("h")).agg(F.min("v").alias("v")).orderBy("h").limit(wanted).select("v").collect()
    pivots = extended(np.array([r[0] for r in sample], dtype=float), top)
    width = len(pivots)
    prefix, posted, reads = min(prefix, width), min(posted, width), sizes(n, width, read)
    handle = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS rows at most
    kind = base.schema["v"].dataType.simpleString()

    def listed(make, length: int):
        def run(batches):
            for b in batches:
                v = np.asarray(b.column(1).flatten(), dtype=float).reshape(-1, d)
                got = lists(make(v), handle.value, length)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * length, pa.int32()), pa.array(got.ravel()))], [*b.schema.names, "list"])

        return run

    rows = Scratch(base.select("vec_id", "v", "row").mapInArrow(listed(lambda v: extended(v, top), max(prefix, posted)), f"vec_id long, v {kind}, row long, list array<int>"), "lists").df
    ask = asked.select("vec_id", "v").mapInArrow(listed(asking, reads), f"vec_id long, v {kind}, list array<int>")
    counts = np.zeros(width, dtype=np.int64)
    for p, c in rows.select(F.explode(F.slice("list", 1, posted)).alias("p")).groupBy("p").count().collect():  # a row for each pivot
        counts[p] = c
    dealt = deal(counts, pivots, shard_rows)
    files = spark.createDataFrame(dealt, "pivot int, shard int, parts int")
    n_parts = max(1, math.ceil(asked.count() / query_rows))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int")
    standing = rows.select("vec_id", "v", "row", "list", F.posexplode(F.slice("list", 1, posted)).alias("place", "pivot")).join(F.broadcast(files), "pivot")  # a row for each pivot
    standing = standing.withColumn("shard", F.col("shard") + F.pmod(F.xxhash64("row"), "parts").cast("int"))
    standing = standing.select("vec_id", "v", "list", "place", "shard", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    places = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).alias("m")) for _, s, m in sorted(dealt)])
    reached = F.array_distinct(F.flatten(F.transform("list", lambda p: F.sequence(F.element_at(places, p + 1)["s"], F.element_at(places, p + 1)["s"] + F.element_at(places, p + 1)["m"] - 1))))
    ask = ask.withColumn("part", part).withColumn("shard", F.explode(reached))
    schema = "query_id long, vec_id array<long>, score array<double>"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        def arrays(t):
            flat = lambda c: np.asarray(t.column(c).combine_chunks().flatten())
            return t.column("vec_id").to_numpy(), flat("v").astype(float).reshape(-1, d), flat("list").reshape(t.num_rows, -1)

        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q_ids, q, q_lists = arrays(left)
            for j, ids, scores in search_shard(q_ids, q, q_lists, *arrays(right), right.column("place").to_numpy(), pivots=width, prefix=prefix, k=k, share=share):
                out["query_id"].append(q_ids[j])
                out["vec_id"].append(ids)
                out["score"].append(scores)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.list_(pa.int64())), "score": pa.array(out["score"], pa.list_(pa.float64()))})

    got = ask.groupBy("shard", "part").cogroup(standing.groupBy("shard", "part")).applyInArrow(search, schema)
    got = got.select("query_id", F.transform(F.arrays_zip("vec_id", "score"), lambda z: F.struct((-z["score"]).alias("s"), z["vec_id"].alias("i"))).alias("z"))
    best = got.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("z"))), 1, k).alias("z"))
    return best.select("query_id", F.posexplode("z").alias("p", "c")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.i").alias("vec_id"), (-F.col("c.s")).alias("score"))
