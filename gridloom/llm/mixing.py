"""Mixing sources to target weights: hierarchical token budgets over a domain-language-source tree, in DataFrame operations only.

A node's budget is shared among its children by weight; a child that can use fewer tokens than its share
gets all it can use, and its shortage goes to its siblings by weight. What a child can use is summed from the leaves up, over descendants of positive weight only (a leaf's tokens times
the epochs allowed), so a shortage leaves a node only when no sibling can take it, and then reaches the ancestor's siblings. Each level is solved in closed form: children in order of
capacity over weight, running sums, and the first that is not exhausted fixes the common rate.

A leaf whose budget is b of t tokens gives every document floor(b / t) times, and then the prefix of its documents in the seeded order of the next
epoch (md5 of seed, epoch and id) until the rest is reached: the document that crosses it is the last taken. Prefix sums go
through slices of the order, counted before the shuffle, and only the slice in which a leaf's prefix ends is sorted; so a leaf that holds
most rows is spread over all tasks. The result of a leaf is one cut in its order, and choosing documents needs no shuffle of texts.

Defined results: null lang, source and domain count as ''; a null doc_id stands in the order by its text's md5; null or blank texts hold no tokens, and come in whole epochs, or
before the cut; documents of equal doc_id stand at one place in the order and are taken together; children of weight 0 or
less get nothing; budgets are rounded down to whole tokens; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, n_words

LEVELS = ("domain", "lang", "source")
SEED = 7
SLICE_DIGITS = 3
#: The largest size of a broadcast plan, names of leaves included, in bytes.
BROADCAST_BYTES = 16 << 20


def domain_of(source: Column, domains: int = 4) -> Column:
    """A domain for a source where the table has none: a fixed hash of its name."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)) - 1
    return F.concat(F.lit("domain"), (digit % domains).cast("string"))


def leaf_columns(docs: DataFrame) -> list[Column]:
    domain = docs["domain"] if "domain" in docs.columns else domain_of(docs["source"])
    return [F.coalesce(c, F.lit("")).alias(f"leaf_{n}") for n, c in zip(LEVELS, (domain, docs["lang"], docs["source"]), strict=True)]


LEAF = [f"leaf_{n}" for n in LEVELS]


def named(docs: DataFrame) -> Column:
    """A document's name in the order: its id, or its text's md5."""
    return F.coalesce(docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"], F.lit("")))).alias("leaf_name")


def order_key(name: Column, epoch: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name))


def _weight(column: str, weights: Mapping[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit(0.0))


def share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``budget`` to children(parent…, child, cap, weight, parent_budget)."""
    usable = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)
    order = Window.partitionBy(*parent).orderBy(F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), F.col(child))
    every = Window.partitionBy(*parent)
    rate = (F.col("parent_budget") - F.coalesce(F.sum(usable).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(F.greatest("weight", F.lit(0.0))).over(order.rowsBetween(0, Window.unboundedFollowing))
    d = children.withColumn("full", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight") <= F.when(F.col("weight") > 0, rate)).otherwise(True))
    spent = F.sum(F.when(F.col("full"), usable).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(every)
    budget = F.when(F.col("full"), usable).otherwise(F.col("weight") * F.try_divide(F.col("parent_budget") - spent, open_weight))
    return d.withColumn("budget", budget).drop("full")


def leaf_budgets(leaves: DataFrame, budget: float | None, budget_share: float, max_epochs: float, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """leaves(leaf…, tokens) with ``budget`` (whole tokens, long). budget: total tokens; None: budget_share of what there is."""
    total = float(budget) if budget is not None else (leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share
    level = leaves.withColumn("cap", F.col("tokens") * float(max_epochs))
    levels = []
    for depth in reversed(range(len(LEAF))):  # what each node can use, from the leaves up
        level = level.withColumn("weight", _weight(LEAF[depth], weights.get(LEVELS[depth])))
        levels.insert(0, level)
        level = level.groupBy(*LEAF[:depth]).agg(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0)).alias("cap"))
    above = None
    for depth, level in enumerate(levels):
        if above is None:
            level, parent = level.withColumn("root", F.lit(0)).withColumn("parent_budget", F.lit(total)), ["root"]
        else:
            parent = LEAF[:depth]
            level = level.join(above, parent)
        level = share(level, parent, LEAF[depth])
        above = level.select(*LEAF[: depth + 1], F.col("budget").alias("parent_budget"))
    return level.select(*LEAF, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def cuts(docs: DataFrame, *, budget: float | None = None, budget_share: float = 0.6, max_epochs: float = 2.0, weights: Mapping[str, Mapping[str, float]] | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(plan, tokens): plan has leaf…, tokens, budget, epochs (whole ones) and cut (the last order key of the next epoch, null if none is taken);
    tokens has doc_id, leaf_name, leaf…, n_tokens for each row of docs(doc_id, text, lang, source)."""
    tokens = Scratch(docs.select(docs["doc_id"], named(docs), *leaf_columns(docs), n_words(docs["text"]).alias("n_tokens")), "tokens").df
    leaves = Scratch(tokens.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "leaves").df
    plan = leaf_budgets(leaves, budget, budget_share, max_epochs, weights or {})
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = Scratch(plan, "plan").df
    small = F.broadcast if plan_bytes(plan) <= BROADCAST_BYTES else (lambda x: x)
    keyed = tokens.join(small(plan.where("rest > 0").select(*LEAF, "epochs", "rest")), LEAF)
    keyed = keyed.withColumn("key", order_key(F.col("leaf_name"), F.col("epochs"), seed)).withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    w = Window.partitionBy(*LEAF).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = keyed.groupBy(*LEAF, "rest", "slice").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    last = slices.where("before < rest").groupBy(*LEAF, "rest").agg(F.max(F.struct("slice", "before")).alias("m")).select(*LEAF, "m.slice", "m.before")
    ends = keyed.join(small(Scratch(last, "slices").df), [*LEAF, "slice"])
    places = ends.groupBy(*LEAF, "slice", "key", "rest", "before").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy(*LEAF, "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0))).where("at < rest")
    cut = places.groupBy(*LEAF).agg(F.max("key").alias("cut"))
    return Scratch(plan.join(cut, LEAF, "left").select(*LEAF, "tokens", "budget", "epochs", "cut"), "cuts").df, tokens


def plan_bytes(plan: DataFrame) -> int:
    """Size of a plan's rows: names, and 128 bytes for the rest."""
    return plan.agg(F.sum(sum((F.octet_length(c) for c in LEAF), F.lit(128)))).first()[0] or 0


def copies(seed: int = SEED) -> Column:
    """How many times a row joined with its leaf's plan is taken."""
    taken = F.coalesce((order_key(F.col("leaf_name"), F.col("epochs"), seed) <= F.col("cut")).cast("long"), F.lit(0))
    return F.col("epochs") + taken


def with_cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(leaf…) joined with the plan; broadcast where its counted size allows."""
    plan = plan.select(*LEAF, "epochs", "cut")
    return rows.join(F.broadcast(plan) if plan_bytes(plan) <= BROADCAST_BYTES else plan, LEAF)


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch: one row for each time that a row of docs is taken."""
    plan, tokens = cuts(docs, seed=seed, **options)
    taken = with_cuts(tokens, plan).withColumn("n", copies(seed)).where("n > 0")
    return taken.select("doc_id", *[F.col(k).alias(n) for k, n in zip(LEAF, LEVELS, strict=True)], "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("epoch"))


def choose(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of docs that are taken at least once, each once, with the columns of docs."""
    plan, _ = cuts(docs, seed=seed, **options)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), named(docs), *leaf_columns(docs))  # so that no column's name can clash
    return with_cuts(rows, plan).where(copies(seed) > 0).select(*[F.col("row")[c].alias(c) for c in docs.columns])
