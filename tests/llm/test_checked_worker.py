"""Encoding and decoding of op8 in one worker."""

import dataclasses
import random

import pyarrow as pa

from gridloom.llm import pieces, sptok


def test_short_documents_pass_one_worker(spark):
    texts = ["", None, "one two  three", "naïve ☃ 中文\n\n x", "a" * 100, "tab\tend "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sptok.checked(docs, chunk=64)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("MapInArrow")  # no second worker over both branches
    rows = {r["doc_id"]: r for r in got.collect()}
    both = {r["doc_id"]: r for r in sptok.decode(sptok.encode(docs, chunk=64)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == both[i]["ids"] and both[i]["text"] == t
        assert rows[i]["round_trip"] is (None if t is None else True) and rows[i]["n_ids"] == (None if t is None else len(rows[i]["ids"]))


def test_units_end_at_marks_and_are_searched_once(monkeypatch):
    rng = random.Random(3)
    letters = "ab zÉß²½.,;!\n\t 0129²°…“中_-'☃ "
    texts = [None, "", *("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(2000)), "x" * 500, " " * 90, "Satz, (Satz) Satz! Satz* satzung satzungen"]
    vocabulary = pieces.load()
    plain = sptok.Encoder(dataclasses.replace(vocabulary, unit=pieces.UNIT))
    want = [None if t is None else [i for u in pieces.UNIT.findall(" " + t) for i in plain.trace(u, 0, plain.best(u, 0, len(u), len(u))[1], len(u))] if t else [] for t in texts]
    monkeypatch.setattr(sptok, "HELD_UNITS", 700)
    encoder = sptok.Encoder(vocabulary)
    assert [x for at in range(0, len(texts), 500) for x in sptok._encoded(encoder, pa.array(texts[at : at + 500], pa.string())).to_pylist()] == want
    monkeypatch.setattr(sptok, "HELD_UNITS", 200_000)
    searched = []
    monkeypatch.setattr(sptok.Encoder, "best", lambda self, s, *x: searched.append(s))
    encoder = sptok.Encoder(vocabulary)
    sptok._encoded(encoder, pa.array(["Satz, (Satz) Satz! Satz*", "Satz. Satz? ,"], pa.string()))
    assert not searched and set(encoder.held) == {" Satz", "Satz", " (", ",", ")", "!", "*", ".", "?", " ,"}
