"""A query for each signal family, over the filled regional panel."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridloom.functions.program import apply, finish, text
from gridloom.functions.sql import DUCK, SPARK
from gridloom.operators import signals
from gridloom.registry import QUERIES, SQL
from gridloom.sources import panels

KEYS = ("inst", "dt")
#: Prices can end exactly on half a millionth, where engines round apart.
DIGITS = {"dpo_compat_and_causal": 4}


def family(spark: SparkSession, sf_dir: str, name: str, panel: str = "regional", filled: bool = True):
    program, hidden = signals.FAMILIES[name]
    df = panels.panel(spark, sf_dir, panel, filled)
    return finish(apply(df, [*signals.base(SPARK), *program(SPARK)]), KEYS, signals.names(program, hidden, SPARK), DIGITS.get(name, 6))


def family_sql(name: str, panel: str = "regional", filled: bool = True) -> str:
    program, hidden = signals.FAMILIES[name]
    return text(panels.ctes(panel, filled), [*signals.base(DUCK), *program(DUCK)], KEYS, signals.names(program, hidden, DUCK), DIGITS.get(name, 6))


for _name in signals.FAMILIES:
    QUERIES[f"sig_{_name}"] = lambda spark, sf_dir, n=_name: family(spark, sf_dir, n)
    SQL[f"sig_{_name}"] = family_sql(_name)
