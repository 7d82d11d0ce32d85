"""The pipeline against its stages done plainly."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from gridloom.llm import pieces, simhash, sptok
from tests.llm.test_mixing import plain_copies
from tests.llm.test_search import brute_components
from tests.llm.test_text import plain_dedup


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    words = [f"wort{i}" for i in range(300)]
    body = lambda n: " ".join(rng.choices(words, k=n))
    passage = "\n".join(body(30) for _ in range(3))
    rows = []
    for i in range(80):
        text = "\n".join(body(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 8)))
        if i % 9 == 0:
            text += "\n" + passage
        rows.append((i, text, ("en", "de", "fr", "es")[i % 4], f"src{i % 5}"))
    rows += [(100, rows[3][1], "es", "src3"), (101, rows[5][1] + " x", "de", "src0"), (102, "123 456", "en", "src1"), (103, "", "en", "src1"), (104, "hallo", "de", "src2"), (105, "hallo", "de", "src2")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["round_trip"]}

    kept = [r for r in rows if any(c.isalpha() for c in r[1])]
    text = plain_dedup([(r[0], r[1]) for r in kept])
    kept = [(r[0], text[r[0]], *r[2:]) for r in kept if text[r[0]] == r[1] or text[r[0]].split()]
    x = np.array([simhash.fingerprint(r[1]) for r in kept], dtype=np.uint64)
    label = brute_components(x)
    least = {c: min(r[0] for r, k in zip(kept, label, strict=True) if k == c) for c in set(label)}
    kept = [r for r, k in zip(kept, label, strict=True) if least[k] == r[0]]
    domain = lambda s: f"domain{int(hashlib.md5(s.encode()).hexdigest()[0], 16) % 4}"
    taken = plain_copies([(*r, domain(r[3])) for r in kept], corpus_pipeline.MIX["budget_share"], 1, corpus_pipeline.MIX["weights"])
    encoder = sptok.Encoder(pieces.load())
    assert got == {r[0]: encoder.encode(r[1]).tolist() for r in kept if r[0] in taken}
    assert len(got) > 40 and 100 not in got
