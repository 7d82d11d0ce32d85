"""Budgets against a plain tree, and prefixes against a plain order."""

import hashlib
import random
from collections import defaultdict

from gridloom.llm import mixing

WEIGHTS = {"lang": {"en": 0.5, "de": 0.3, "fr": 0.2}}


def fill(budget, caps, weights):
    """Shares by repeated passes: whoever holds less than its share is closed, and the rest is shared anew."""
    got, open_ = {}, {k for k in caps if weights[k] > 0}
    left = budget
    while open_:
        rate = left / sum(weights[k] for k in open_)
        short = {k for k in open_ if caps[k] <= rate * weights[k]}
        if not short:
            got |= {k: rate * weights[k] for k in open_}
            break
        for k in short:
            got[k] = caps[k]
            left -= caps[k]
        open_ -= short
    return {k: got.get(k, 0.0) for k in caps}


def plain_copies(rows, share, epochs, weights):
    """doc_id to the times it is taken; rows: (doc_id, text, lang, source, domain)."""
    leaf = defaultdict(list)
    for i, t, lang, source, domain in rows:
        leaf[domain, lang, source].append((i, len(t.encode().split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaf.items()}
    weighs = lambda q: weights["lang"].get(q[1], 0) > 0
    by = lambda keys: {k: epochs * sum(n for q, n in tokens.items() if q[: len(k)] == k and (len(k) > 1 or weighs(q))) for k in keys}
    want = defaultdict(int)
    domains = by({k[:1] for k in leaf})
    for dom, b in fill(share * sum(tokens.values()), domains, defaultdict(lambda: 1.0)).items():
        langs = by({k[:2] for k in leaf if k[:1] == dom})
        for lang, b2 in fill(b, langs, {k: weights["lang"].get(k[1], 0) for k in langs}).items():
            for k, b3 in fill(b2, by({q for q in leaf if q[:2] == lang}), defaultdict(lambda: 1.0)).items():
                budget = int(b3 + 1e-6)
                full = budget // tokens[k] if tokens[k] else 0
                rest, at = budget - full * tokens[k], 0
                for i, n in sorted(leaf[k], key=lambda x: hashlib.md5(f"{mixing.SEED}:{full}:{x[0]}".encode()).hexdigest()):
                    want[i] += full + (at < rest)
                    at += n
    return {k: v for k, v in want.items() if v}


def test_budgets_and_prefixes(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(8)}"
        rows.append((i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(("en", "en", "de", "fr", "xx")), source, f"d{rng.randrange(3)}"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    out = mixing.mix(d, budget_share=0.7, max_epochs=2.0, weights=WEIGHTS).collect()
    got = defaultdict(int)
    for r in out:
        got[r["doc_id"]] += 1
    assert plain_copies(rows, 0.7, 2, WEIGHTS) == dict(got)
    assert max(r["epoch"] for r in out) >= 1


def test_shortages_reach_siblings_before_ancestors(spark):
    """Languages without weight are no capacity: what A cannot use goes to B, and nothing is lost."""
    rows = [(i, "w " * 10, "en", "s", "A") for i in range(10)] + [(100 + i, "w " * 10, "xx", "s", "A") for i in range(200)] + [(1000 + i, "w " * 10, "en", "s", "B") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    got = {r["leaf_domain"]: r["budget"] for r in mixing.cuts(d, budget=1000, max_epochs=1.0, weights={"lang": {"en": 1.0}})[0].where("leaf_lang = 'en'").collect()}
    assert got == {"A": 100, "B": 900}


def test_null_ids_are_not_one_document(spark):
    d = spark.createDataFrame([(None, f"w{i} " * 10, "en", "s") for i in range(50)], "doc_id long, text string, lang string, source string")
    out = mixing.mix(d, budget=200, max_epochs=1.0).collect()
    assert len(out) == 20
