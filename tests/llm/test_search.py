"""Near-duplicates, nearest neighbours and license matches against brute force."""

import random

import numpy as np

from gridloom.llm import licenses, permindex, simhash
from gridloom.llm.components import components, extended


def brute_components(x, reach=2):
    label = np.arange(len(x))
    while True:
        new = np.array([label[np.bitwise_count(x ^ v) <= reach].min() for v in x])
        if (new == label).all():
            return label
        label = new


def clouds(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, size=n // 10, dtype=np.uint64)
    x = rng.choice(centres, n)
    for _ in range(3):
        x = np.where(rng.random(n) < 0.5, x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), x)
    return np.unique(x)


def test_shard_links_are_those_of_brute_force():
    for seed in range(3):
        x = clouds(3000, seed)
        a, b = simhash.shard_links(x)
        assert (simhash._forest(len(x), a, b) == brute_components(x)).all()


def test_dense_ball_is_exact():
    x = np.unique(np.array([(1 << i) | (1 << j) for i in range(64) for j in range(64)], dtype=np.uint64))
    a, b = simhash.shard_links(x)
    assert (simhash._forest(len(x), a, b) == brute_components(x)).all()
    a, b = simhash._ball_links(x, 2)
    assert (simhash._forest(len(x), a, b) == brute_components(x)).all()


def test_every_link_meets_in_a_shard():
    x = clouds(4000, 5)
    tree = simhash.grow(x[::3], 5)
    shards = {s: set(at.tolist()) for s, at in simhash.route(x, tree, 2)}
    assert len(shards) > 8
    for i in range(0, len(x), 7):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2):
            assert any(i in s and j in s for s in shards.values())


def test_sharded_links(spark):
    x = clouds(3000, 9)
    d = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = {r["node"]: r["label"] for r in components(simhash.links(d, len(x), shard_rows=200)).collect()}
    want = brute_components(x)
    groups = {}
    for v, c in zip(x.view(np.int64).tolist(), want, strict=True):
        groups.setdefault(c, []).append(v)
    for g in groups.values():
        assert {got.get(v, v) for v in g} == {min(g)}


def test_components_of_a_long_path(spark):
    rng = random.Random(3)
    nodes = list(range(300))
    rng.shuffle(nodes)
    edges = [(a, b) for a, b in zip(nodes, nodes[1:], strict=False)] + [(1000, 1001), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 0 for n in nodes} | {1000: 1000, 1001: 1000}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[100:140] = x[100]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = permindex.nearest(v, v.where("vec_id % 50 = 0"), shard_rows=300, query_rows=40).toPandas()
    hits = []
    for q, g in rows.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -s))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]], rtol=1e-14, atol=1e-13)
        hits.append(np.isin(best, g["vec_id"]).mean())
        if q == 100:
            assert g["vec_id"].tolist()[:5] == best.tolist()[:5]
    assert np.mean(hits) >= 0.9


def test_footrule_gain_orders_like_the_distance():
    rng = np.random.default_rng(1)
    lists = np.array([rng.permutation(12)[:5] for _ in range(40)], dtype=np.int16)
    place = np.full((40, 12), 5, dtype=np.int16)
    for i, row in enumerate(lists):
        place[i, row] = np.arange(5)
    gain = permindex.footrule_gain(place[:6].T, lists).T
    distance = np.abs(place[:6, None] - place[None]).sum(axis=2)
    assert len(set((2 * gain + distance).ravel().tolist())) == 1


def test_a_shard_meets_only_the_files_that_a_query_reads():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = x[:40]
    rows, asked = permindex.lists(x, pivots, 12), permindex.lists(x[:30], pivots, 10)
    ids = np.arange(400)
    twice = np.concatenate([ids, ids])
    found = {ids[j]: (set(i.tolist()), s) for j, i, s in permindex.search_shard(ids[:30], x[:30], asked, ids[twice], x[twice], rows[twice], np.repeat([0, 1], 400), pivots=40, prefix=12, k=400, share=1.0, batch=7)}
    for j in range(30):
        met = {i for i in range(400) if i != j and set(rows[i, :2]) & set(asked[j])}
        assert met == found[j][0] and len(found[j][1]) == len(met)


def test_files_are_dealt_to_bounded_shards():
    rng = np.random.default_rng(6)
    counts = np.concatenate([rng.integers(0, 40, 90), [1000, 170]])
    dealt = permindex.deal(counts, rng.normal(size=(92, 5)), 100)
    load = {}
    for p, first, parts in dealt:
        for s in range(first, first + parts):
            load[s] = load.get(s, 0) + counts[p] / parts
    assert sorted(p for p, _, _ in dealt) == list(range(92)) and max(load.values()) <= 100 and dict((p, m) for p, _, m in dealt)[90] == 10


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 6)).round(3)
    x[:400] = x[0]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = permindex.nearest(v, v.where("vec_id % 100 = 0"), shard_rows=60, query_rows=5).toPandas()
    assert rows.groupby("query_id").size().tolist() == [20] * 9
    assert rows[rows.query_id == 0].sort_values("rank")["vec_id"].tolist() == list(range(1, 21)) or (x[rows[rows.query_id == 0]["vec_id"]] @ x[0]).min() > (x[0] ** 2).sum()


def test_band_settings_guarantee_collisions():
    for r in (0.1, 0.25, 0.5):
        b = licenses.bands_for(r, 1)
        assert 1 - (1 - r) ** b >= licenses.CERTAINTY > 1 - (1 - r) ** (b - 1)


def test_licenses_against_brute_force():
    rng = random.Random(8)
    finder = licenses.Finder(licenses.TEMPLATES)
    filler = [f"w{i}" for i in range(400)]
    texts, planted = [], []
    for i in range(120):
        words = [rng.choice(filler) for _ in range(rng.randrange(0, 400))]
        name = rng.choice(list(licenses.TEMPLATES)) if i % 3 else None
        at = rng.randrange(0, len(words) + 1)
        body = licenses.TEMPLATES[name].upper() if name and i % 2 else licenses.TEMPLATES.get(name, "")
        texts.append("é " + " ".join([*words[:at], body, *words[at:]]))
        planted.append(name)
    for text, name, found in zip(texts, planted, finder.find(texts), strict=True):
        words = licenses._WORD.findall(text.encode().lower())
        there = set(finder.exact(words))
        want = {k for k, s in finder.sets.items() if len(s & there) / len(s) >= licenses.CONTAINMENT}
        got = {m[0] for m in found}
        assert got == want and (name is None or name in got)
        for m in found:
            if m[3] == 1:
                assert licenses._WORD.findall(text[m[1] : m[2]].encode().lower()) == finder.templates[m[0]]


def test_components_extended_by_further_edges(spark):
    rng = np.random.default_rng(11)
    for n in (0, 1, 40):
        edges = [tuple(map(int, e)) for e in rng.integers(0, 90, size=(60 + n, 2))]
        of = lambda x: spark.createDataFrame(x, "u long, v long")
        got = {r["node"]: r["label"] for r in extended(components(of(edges[:60])), of(edges[60:])).collect()}
        assert got == {r["node"]: r["label"] for r in components(of(edges)).collect()}
