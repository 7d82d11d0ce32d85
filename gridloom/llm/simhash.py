"""SimHash near-duplicates: sharded vantage-point trees over 64-bit fingerprints.

``near_duplicates`` fingerprints every document, routes the distinct fingerprints through the top of a
vantage-point tree (fitted on a bounded sample) to shards, copies a fingerprint to the far side of each sphere whose
boundary is within the link radius, and searches each shard's own vantage-point tree for exact pairs. A shard
reports a spanning forest of its links, not all pairs, so no link between different fingerprints is lost and dense groups
stay linear. Components then join the forests.

Defined results: null and blank texts have fingerprint 0 and link like any other; rows equal in doc_id and text share
a fingerprint and a component; a null doc_id never names a component unless all its documents' ids are null; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch
from gridloom.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
SHARD_ROWS = 4096
SAMPLE_ROWS = 8192
LEAF_ROWS = 96


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles (ASCII lower case)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        parts = zip(*(words[i:] for i in range(shingle)), strict=False)
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, parts)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        block = h[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row of docs(doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, fp long")


def grow(sample: np.ndarray, depth: int):
    """Top of a vantage-point tree: (vantage, radius, inside, outside) nodes over the sample's uint64 fingerprints, None for a shard."""
    if depth == 0 or len(sample) < 4:
        return None
    vantage = sample[0]
    d = np.bitwise_count(sample ^ vantage)
    radius = int(np.median(d))
    inside = d <= radius
    if inside.all():
        return None
    return vantage, radius, grow(sample[inside][1:], depth - 1), grow(sample[~inside], depth - 1)


def route(fps: np.ndarray, tree, reach: int, prefix: int = 1):
    """Yields (shard, positions in fps): a fingerprint goes to its own side and, if a neighbour within ``reach`` can lie outside, there too."""

    def walk(at, node, code):
        if node is None or not len(at):
            if len(at):
                yield code, at
            return
        vantage, radius, inner, outer = node
        d = np.bitwise_count(fps[at] ^ vantage)
        yield from walk(at[d <= radius], inner, 2 * code)
        yield from walk(at[d > radius - reach], outer, 2 * code + 1)

    yield from walk(np.arange(len(fps)), tree, prefix)


def _leaf_links(x: np.ndarray, reach: int):
    """Pairs of positions in x within ``reach``."""
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= reach, 1))
    return a, b


def _ball_links(x: np.ndarray, reach: int):
    """The same for a dense set that no sphere divides: looks up every fingerprint of each one's ball, a fixed number."""
    order = np.argsort(x)
    s = x[order]
    masks = [np.uint64(1 << i) for i in range(64)]
    balls = [np.uint64(0)]
    for _ in range(reach):
        balls = list({int(m) ^ int(k) for m in balls for k in [0, *map(int, masks)]})
        balls = [np.uint64(m) for m in balls]
    found_a, found_b = [], []
    for m in balls:
        if m:
            other = s ^ m
            at = np.minimum(np.searchsorted(s, other), len(s) - 1)
            hit = np.nonzero((s[at] == other) & (other > s))[0]
            found_a.append(order[hit])
            found_b.append(order[at[hit]])
    return np.concatenate(found_a), np.concatenate(found_b)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position reachable from each of n."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def shard_links(x: np.ndarray, reach: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct sorted fingerprints x: positions (node, root), by a vantage-point tree."""
    found_a, found_b = [], []

    def search(at: np.ndarray, tries: int) -> None:
        if len(at) < 2:
            return
        if len(at) <= LEAF_ROWS:
            a, b = _leaf_links(x[at], reach)
        else:
            for k in range(3):
                d = np.bitwise_count(x[at] ^ x[at[(k * 7919 + len(at) // 2) % len(at)]]).astype(np.int64)
                radius = int(np.median(d))
                inner, outer = at[d <= radius], at[d > radius - reach]
                if max(len(inner), len(outer)) <= 0.8 * len(at):
                    search(inner, tries)
                    search(outer, tries)
                    return
            a, b = _ball_links(x[at], reach) if len(at) > 1024 else _leaf_links(x[at], reach)
        roots = _forest(len(at), a, b)
        moved = np.nonzero(roots != np.arange(len(at)))[0]
        found_a.append(at[moved])
        found_b.append(at[roots[moved]])

    search(np.arange(len(x)), 0)
    if not found_a:
        none = np.array([], dtype=np.int64)
        return none, none
    roots = _forest(len(x), np.concatenate(found_a), np.concatenate(found_b))
    moved = np.nonzero(roots != np.arange(len(x)))[0]
    return moved, roots[moved]


def links(distinct: DataFrame, n: int, reach: int = RADIUS, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(u, v): a spanning forest per shard over distinct(fp long). n: its rows; sample_rows bounds what fits the top of the tree."""
    depth = max(0, math.ceil(math.log2(max(1, n) / shard_rows)))
    sample = [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp")).limit(sample_rows).collect()] if depth else []
    tree = grow(np.array(sample, dtype=np.int64).view(np.uint64), depth)

    def deal(batches):
        for b in batches:
            x = np.asarray(b.column(0)).astype(np.int64)
            for shard, at in route(x.view(np.uint64), tree, reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, dtype=np.int64)), pa.array(x[at])], ["shard", "fp"])

    def search(t: pa.Table) -> pa.Table:
        x = np.unique(np.asarray(t.column("fp").combine_chunks()).astype(np.int64).view(np.uint64))
        a, b = shard_links(x, reach)
        return pa.table({"u": x[a].view(np.int64), "v": x[b].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(search, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of docs; component_id is the least doc_id linked, itself included."""
    fps = Scratch(fingerprints(docs, shingle), "fingerprints").df
    distinct = Scratch(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "distinct").df
    forest = links(distinct, distinct.count(), reach)
    label = Scratch(components(forest).join(distinct.withColumnRenamed("fp", "node"), "node"), "labels").df
    least = label.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = label.join(least, "label").select(F.col("node").alias("fp"), "component_id")
    of_fp = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "doc").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
