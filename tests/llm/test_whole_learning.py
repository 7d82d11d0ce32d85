"""The language model and its bounds come from all labelled documents."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.llm import langid

N = 30_000


def spread(spark):
    """Documents of which each hash of the id has its own words, in two languages."""
    words = ["town", "bread", "winter", "children", "zq", "help", "people", "xkjq"]
    docs = spark.range(N).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "aa").otherwise("bb").alias("lang"))
    listed = F.array(*map(F.lit, words))
    picks = [F.element_at(listed, (F.pmod(F.hash("doc_id", F.lit(k)), F.lit(len(words))) + 1).cast("int")) for k in range(4)]
    return docs.select("doc_id", F.concat_ws(" ", *picks).alias("text"), "lang")


def test_fit_counts_all_labelled_documents(spark):
    docs = spread(spark)
    model = langid.fit(docs, rounds=1)
    t = docs.toPandas()
    ids, longest = langid.vocabulary()
    start = 1 / (np.arange(len(ids)) + 10.0)
    p = np.append(start / start.sum(), langid.UNKNOWN)[:, None]
    for k, lang in enumerate(["aa", "bb"]):
        n = t[t["lang"] == lang]["text"].str.split().explode().value_counts()
        got = langid.Lattice(list(n.index), ids, longest, len(ids)).expected(p, n.to_numpy()[:, None].astype(float))[: len(ids), 0] + langid.ADDED
        assert np.allclose(model["p"][: len(ids), k], got / got.sum(), rtol=1e-9)


def test_bounds_are_medians_over_all_labelled_documents(spark):
    docs = spread(spark)
    model = langid.fit(docs)
    got = langid.calibrate(docs, model)
    t = docs.toPandas()
    scorer = langid.Scorer(langid.Trie(model["ids"]), model["p"], model["longest"])
    rows = []
    for n in (1, 2, 4):
        sums, letters = scorer.sums([x.split()[:n] for x in t["text"]])
        best = (model["prior"] + sums).argmax(axis=1)
        rows.append(pd.DataFrame({"n": n, "lang": t["lang"], "pred": np.array(model["langs"])[best], "fit": sums[np.arange(N), best] / letters}))
    rows = pd.concat(rows)
    for (lang, n), fit in rows[rows["lang"] == rows["pred"]].groupby(["lang", "n"])["fit"]:
        middle = fit.median()
        deviation = max(langid.LEAST_DEVIATION, 1.4826 * (fit - middle).abs().median())
        assert np.allclose(got[lang, langid.window(int(n))], (middle, deviation), atol=2 * langid.STEP)
    assert len(got) >= 3


def test_lattice_sums_do_not_depend_on_the_words_beside(spark):
    ids, longest = langid.vocabulary()
    p = np.random.default_rng(3).uniform(0.001, 0.1, size=(len(ids) + 1, 2))
    words = ["a", "straße", "привет", "internationalization", "中文字", "ab", "q" * 24]
    together = langid.Lattice(words, ids, longest, len(ids))
    a, b = together.forward(p), together.backward(p)
    for i, w in enumerate(words):
        alone = langid.Lattice([w], ids, longest, len(ids))
        assert np.allclose(a[together.last[i]], alone.forward(p)[alone.last[0]], rtol=1e-12)
        assert np.allclose(b[together.first[i]], a[together.last[i]], rtol=1e-9)
