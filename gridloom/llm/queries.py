"""The corpus operators' queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import langid, licenses, line_dedup, mixing, nbsvm, permindex, quality_crf, secrets, simhash, sptok
from gridloom.llm.common import table


#: Weights of op3's tree: languages as given, domains and sources alike.
MIX = {"budget_share": 0.6, "max_epochs": 2.0, "weights": {"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}}}


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permindex.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), **MIX)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.screen(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sptok.checked(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op10_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: op9 in SQL: the least runs of 50 words that start and end with each line, all but the first place of each, and the lines that they hold (without those of an overlapped first place).
OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
j AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c, sum(n) OVER (PARTITION BY doc_id) AS total FROM w WHERE n > 0),
m AS (SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY c - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS ms, count(*) OVER (PARTITION BY doc_id ORDER BY c RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS me FROM j),
runs AS (SELECT doc_id, j AS s, ms AS k FROM m WHERE total - (c - n) >= 50 UNION SELECT doc_id, j - me + 1, me FROM m WHERE c >= 50),
named AS (SELECT r.doc_id, r.s, r.k, list(j.line ORDER BY j.j) AS lines FROM runs r JOIN j ON j.doc_id = r.doc_id AND j.j >= r.s AND j.j < r.s + r.k GROUP BY ALL),
later AS (SELECT doc_id, CASE WHEN doc_id = d0 THEN greatest(s, s0 + k) ELSE s END AS a, s + k AS z FROM (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS d0, first_value(s) OVER w AS s0 FROM named WINDOW w AS (PARTITION BY lines ORDER BY doc_id, s)) q WHERE place > 1),
gone AS (SELECT DISTINCT j.doc_id, j.i FROM later r JOIN j ON j.doc_id = r.doc_id AND j.j >= r.a AND j.j < r.z)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS n_removed
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""


def _op3_sql() -> str:
    """op3 in SQL: what each node can use from the leaves up, each level's closed form from the root down, then every leaf's order."""
    langs = " ".join(f"WHEN '{k}' THEN {w!r}" for k, w in MIX["weights"]["lang"].items())
    names, weights = ("domain", "lang", "source"), ("1.0", f"CASE lang {langs} ELSE 0.0 END", "1.0")
    ctes = [
        "d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name, 'domain' || CAST((instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4 AS VARCHAR) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, "
        r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents)",
        "leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL)",
        f"u3 AS (SELECT domain, lang, source, tokens * {MIX['max_epochs']} AS cap, {weights[2]} AS weight FROM leaves)",
        f"u2 AS (SELECT domain, lang, sum(CASE WHEN weight > 0 THEN cap ELSE 0 END) AS cap, {weights[1]} AS weight FROM u3 GROUP BY domain, lang)",
        f"u1 AS (SELECT domain, sum(CASE WHEN weight > 0 THEN cap ELSE 0 END) AS cap, {weights[0]} AS weight FROM u2 GROUP BY domain)",
        f"b0 AS (SELECT 0 AS root, CAST(sum(tokens) * {MIX['budget_share']} AS DOUBLE) AS budget FROM leaves)",
    ]
    for i, n in enumerate(names, 1):
        keys, parent = ", ".join(names[:i]), ", ".join(names[: i - 1]) or "root"
        w = f"(PARTITION BY {parent} ORDER BY CASE WHEN weight > 0 THEN cap / weight END NULLS LAST, {n} ROWS BETWEEN"
        ctes += [
            f"c{i} AS (SELECT c.*, b.budget AS pb{', 0 AS root' if i == 1 else ''} FROM u{i} c JOIN b{i - 1} b {'ON true' if i == 1 else f'USING ({parent})'})",
            f"r{i} AS (SELECT *, CASE WHEN weight > 0 THEN cap ELSE 0 END AS u, (pb - coalesce(sum(CASE WHEN weight > 0 THEN cap ELSE 0 END) OVER {w} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(greatest(weight, 0)) OVER {w} CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate FROM c{i})",
            f"f{i} AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight <= rate ELSE true END AS done FROM r{i})",
            f"b{i} AS (SELECT {keys}, CASE WHEN done THEN u ELSE weight * (pb - sum(CASE WHEN done THEN u ELSE 0 END) OVER (PARTITION BY {parent})) / nullif(sum(CASE WHEN done THEN 0 ELSE weight END) OVER (PARTITION BY {parent}), 0) END AS budget FROM f{i})",
        ]
    ctes += [
        "p AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(whole / tokens) AS BIGINT) ELSE 0 END AS epochs FROM (SELECT leaves.*, CAST(floor(budget + 1e-6) AS BIGINT) AS whole FROM leaves JOIN b3 USING (domain, lang, source)) q)",
        f"o AS (SELECT d.*, epochs, whole - epochs * tokens AS rest, md5(concat_ws(':', '{mixing.SEED}', CAST(epochs AS VARCHAR), name)) AS k FROM d JOIN p USING (domain, lang, source))",
        "s AS (SELECT domain, lang, source, k, sum(n_tokens) AS n FROM o GROUP BY ALL)",
        "t AS (SELECT domain, lang, source, k, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)",
    ]
    return f"WITH {', '.join(ctes)} SELECT o.doc_id, domain, lang, source, o.n_tokens, unnest(range(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS epoch FROM o JOIN t USING (domain, lang, source, k)"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_permutation_index, op3_mixing, op4_license_scan, op5_language_id, op6_quality_rules, op7_simhash, op8_sentencepiece, op9_line_dedup, op10_nbsvm)}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": _op3_sql(), "op9_line_dedup": OP9_SQL}
