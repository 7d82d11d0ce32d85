"""Every operator on nulls, blanks, repeated rows, clashing columns and empty tables."""

import pytest

from gridloom.llm import langid, licenses, line_dedup, mixing, nbsvm, permindex, quality_crf, secrets, simhash, sptok

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, y int, norm double, n_removed long, leaf_lang string, epochs long"
LONG = " ".join(f"word{i % 997} und der" for i in range(20_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon " * 12, "en", "a"),
    (1, "alpha beta gamma delta epsilon " * 12, "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \n\t\n ", "de", "b"),
    (None, "alpha beta gamma delta epsilon " * 12, "de", None),
    (5, LONG, "de", "b"),
    (6, "é▁  中文 \U0001f600\r\n\x0bx", "fr", "c"),
    (7, "12345 ... 67890 !!!", None, "c"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 8, 1, 0.5, 3, "z", 4) for r in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame([(r[0], i % 2, "clash") for i, r in enumerate(rows)], "doc_id long, quality int, text string")


OPERATORS = {
    "secrets": lambda s, d, lab: secrets.find_secrets(d),
    "mixing": lambda s, d, lab: mixing.mix(d),
    "choose": lambda s, d, lab: mixing.choose(d),
    "licenses": lambda s, d, lab: licenses.find_licenses(d),
    "langid": lambda s, d, lab: langid.identify(d),
    "crf": lambda s, d, lab: quality_crf.screen(d, lab),
    "simhash": lambda s, d, lab: simhash.near_duplicates(d),
    "sptok": lambda s, d, lab: sptok.checked(d),
    "lines": lambda s, d, lab: line_dedup.dedup_lines(d),
    "nbsvm": lambda s, d, lab: nbsvm.classify(d, lab),
}
ONE_EACH = set(OPERATORS) - {"mixing", "choose"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    d = frame(spark, [])
    assert OPERATORS[name](spark, d, labels(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    rows = OPERATORS[name](spark, frame(spark, ROWS), labels(spark, ROWS)).collect()
    if name in ONE_EACH:
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((r[0] for r in ROWS), key=str)
    got = {r["doc_id"]: r for r in rows}
    if name == "langid":
        assert [got[k]["lang_pred"] for k in (2, 3, 4, 7)] == ["und"] * 4 and got[2]["score"] == 0
        assert all(r["lang_pred"] != "und" for r in rows if r["doc_id"] in (1, 5, 6))
    if name == "sptok":
        assert all(r["round_trip"] for r in rows if r["doc_id"] != 2) and got[2]["ids"] is None and got[2]["round_trip"] is None and got[3]["n_ids"] == 0
    if name == "simhash":
        assert got[2]["fingerprint"] == got[3]["fingerprint"] == got[4]["fingerprint"] == "0" * 16
        assert {got[k]["component_id"] for k in (2, 3, 4)} == {2} and got[None]["component_id"] == 1
    if name == "lines":
        assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["n_removed"] == 0
        kept = [r for r in rows if r["doc_id"] in (1, None)]
        assert sum(r["n_removed"] for r in kept if r["doc_id"] is None) == 0 and all(r["n_removed"] == 1 for r in kept if r["doc_id"] == 1)
    if name == "crf":
        assert got[2]["base_failed"] and got[4]["n_words"] == 0 and not got[3]["kept"]
    if name == "nbsvm":
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "secrets":
        assert all(r["spans"] == "" for r in rows)
    if name == "choose":
        assert set(rows[0].asDict()) == set(SCHEMA.replace(",", "").split()[::2])


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, v string")


def test_vectors_empty(spark):
    v = vectors(spark, [])
    assert permindex.nearest(v, v).count() == 0


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    v = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0]), (9, [-3.0, 5.0])])
    rows = permindex.nearest(v, v.where("vec_id % 4 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 9, -3.0), (8, 1, 0, 1.0), (8, 2, 1, 1.0), (8, 3, 9, -3.0)]
