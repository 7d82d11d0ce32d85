"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, in DataFrame operations only.

Lines without a word are no part of the sequences and are never deleted. A run of consecutive lines of a document repeats
if the same lines stand at an earlier place (by doc_id, then position); every run of at least ``min_words`` words that repeats is
deleted at its later places, whatever its number of lines, so maximal repeated runs go as a whole and the first copy stays.

* Ranks: suffixes start with the order of their first line's ID. Each round doubles the compared length: the pair
  (rank here, rank ``k`` lines on) is ranked within its present rank. Equal pairs are counted before the shuffle, and the
  running sums go through slices of the second rank, so neither a frequent line nor a frequent prefix meets in one task.
  A suffix that is alone with its prefix is settled and leaves (discarding); equal ranks after a round at length k are exactly the
  suffixes whose longest common prefix is k or more: an interval of the array.
* Intervals are implicit, as ranks: a run of L lines, k <= L < 2k, is named by the ranks at length k of its first and of its last k lines; suffixes of
  the same name are the interval with a common prefix of L lines or more. In each interval all but the earliest run are later copies; where a copy overlaps that
  first one, in its own document, the lines of the first one stay. Names that hold many runs are looked up by broadcast (at most HOT of them), so that they need no shuffle.
* Only runs that no shorter run of ``min_words`` words starts or ends like need to be looked up (each longer repeated
  run is covered by those within it), so lengths stop at ``min_words`` lines and the rounds at log2 of that.

Defined results: null text stays null; rows equal in doc_id and text count as one document and share its result; a null
doc_id sorts first; equal runs within one document are copies too; twelve equal lines of ten words keep the first five; further columns pass through ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch, n_words

MIN_WORDS = 50
#: Slices of the second rank in which running sums are made.
SLICES = 1024
#: Names with more than one HOT-th of all runs are looked up by broadcast; there can be no more of them than that.
HOT = 2000
DOC = ("doc_id", "th")


def doc_key(doc_id: Column) -> Column:
    """doc_id as a long that joins and sorts; the least one stands for null."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)).cast("long"))


def _reach(lines: Column, enough: int) -> Column:
    """How many of the first lines hold ``enough`` words; null if all don't."""
    zero = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("m"))
    step = lambda a, x: F.when(a["w"] >= enough, a).otherwise(F.struct((a["w"] + x["w"]).alias("w"), (a["m"] + 1).alias("m")))
    return F.aggregate(lines, zero, step, lambda a: F.when(a["w"] >= enough, a["m"]))


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each line with a word: doc_id, th (hash of the text), j (its number among those), i (among all lines), the
    line's ID (h1, h2), and the lengths in lines of the least runs of min_words words that start (ms) and end (me) with it."""
    cells = F.filter(
        F.transform(
            F.split("text", "\n", -1),
            lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), n_words(x).alias("w")),
        ),
        lambda c: c["w"] > 0,
    )
    rows = docs.select(doc_key(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("th"), cells.alias("c"))
    ahead = lambda j: _reach(F.slice(F.col("c"), j + 1, F.lit(min_words)), min_words)
    back = lambda j: _reach(F.reverse(F.slice(F.col("c"), F.greatest(j + 2 - min_words, F.lit(1)), F.least(j + 1, F.lit(min_words)))), min_words)
    one = lambda c, f, j: F.when(c["w"] >= min_words, F.lit(1)).otherwise(f(j))
    full = F.transform("c", lambda c, j: F.struct(j.alias("j"), c["i"].alias("i"), c["h1"].alias("h1"), c["h2"].alias("h2"), one(c, ahead, j).alias("ms"), one(c, back, j).alias("me")))
    return rows.select(*DOC, F.inline(full))


def _ranked(rows: DataFrame, key: list[str], cut: Column) -> DataFrame:
    """rows(…, r, key…) with the rank of (r, key) in place of both; suffixes alone with their rank go. cut: key's slice, in its order."""
    pairs = rows.groupBy("r", *key).agg(F.count("*").alias("n")).withColumn("cut", cut)
    sums = pairs.groupBy("r", "cut").agg(F.sum("n").alias("s"))
    w = Window.partitionBy("r").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("r", "cut", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("off"))
    w = Window.partitionBy("r", "cut").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    ranks = pairs.withColumn("low", F.coalesce(F.sum("n").over(w), F.lit(0))).where("n > 1")
    ranks = ranks.join(sums, ["r", "cut"]).select("r", *key, (F.col("r") + F.col("off") + F.col("low")).alias("rank"))
    return rows.join(ranks, ["r", *key]).drop("r", *key).withColumnRenamed("rank", "r")


def _marked(windows: DataFrame) -> DataFrame:
    """(doc_id, th, a, z): the lines a to z - 1 of later copies among windows(doc_id, th, s, len, ra, rb)."""
    key = ["len", "ra", "rb"]
    at = F.struct("doc_id", "th", "s")
    windows = Scratch(windows, "windows").df
    first = windows.groupBy(*key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where("last > first").drop("last")
    first = Scratch(first, "first").df
    hot = F.col("n") > F.lit(windows.count() // HOT)
    known = windows.join(F.broadcast(first.where(hot).drop("n")), key, "left")  # HOT rows at most
    rest = known.where("first IS NULL").drop("first").join(first.where(~hot).drop("n"), key)
    copies = known.where("first IS NOT NULL").unionByName(rest).where(at > F.col("first"))
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    begin = F.when(own, F.greatest(F.col("s"), F.col("first.s") + F.col("len"))).otherwise(F.col("s"))
    return copies.select(*DOC, begin.alias("a"), (F.col("s") + F.col("len")).alias("z")).where("a < z")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, i): the lines of docs(doc_id, text) that later copies of repeated runs hold."""
    lines = Scratch(line_table(docs, min_words), "lines").df
    start = lines.withColumn("r", F.lit(0).cast("long"))
    level = Scratch(_ranked(start, ["h1", "h2"], F.shiftright("h1", 54)), "ranks").df
    repeated = level
    runs = repeated.where("ms is not null").select(*DOC, F.col("j").alias("s"), F.col("ms").alias("len"))
    runs = runs.unionByName(repeated.where("me is not null").select(*DOC, (F.col("j") - F.col("me") + 1).alias("s"), F.col("me").alias("len")))
    runs = Scratch(runs.distinct(), "runs").df
    most, total = runs.agg(F.max("len")).first()[0] or 0, max(1, lines.count())
    k, marked = 1, []
    level = level.select(*DOC, "j", "r")
    while k <= most:
        here = runs.where((F.col("len") >= k) & (F.col("len") < 2 * k)).join(level.select(*DOC, F.col("j").alias("s"), F.col("r").alias("ra")).distinct(), [*DOC, "s"])
        if k > 1:
            tail = level.select(*DOC, F.col("j").alias("e"), F.col("r").alias("rb")).distinct()
            here = here.withColumn("e", F.col("s") + F.col("len") - k).join(tail, [*DOC, "e"]).drop("e")
        else:
            here = here.withColumn("rb", F.col("ra"))
        marked.append(Scratch(_marked(here), "marked").df)
        if 2 * k <= most:
            w = Window.partitionBy(*DOC).orderBy("j").rangeBetween(k, k)
            pairs = level.withColumn("r2", F.first("r").over(w)).where("r2 is not null")
            level = Scratch(_ranked(pairs, ["r2"], F.floor(F.col("r2") * SLICES / total)), "ranks").df
        k *= 2
    if not marked:
        return repeated.select(*DOC, "i").limit(0)
    gone = marked[0]
    for m in marked[1:]:
        gone = gone.unionByName(m)
    gone = gone.select(*DOC, F.explode(F.sequence(F.col("a"), F.col("z") - 1)).alias("j")).distinct()
    return gone.join(repeated.select(*DOC, "j", "i"), [*DOC, "j"]).select(*DOC, "i").distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the deleted lines out of ``text``, and n_lines and n_removed (long): lines before, and lines deleted."""
    named = docs.select(F.col("doc_id"), F.col("text"))
    gone = repeated_lines(named, min_words).groupBy(*DOC).agg(F.sort_array(F.collect_set("i")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    both = docs.join(gone, (doc_key(docs["doc_id"]) == gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__th"]), "left")
    lines = F.split(docs["text"], "\n", -1)
    stops = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size(lines)))
    left = F.flatten(F.transform(F.sequence(F.lit(1), F.size("__gone") + 1), lambda t: F.slice(lines, F.element_at(stops, t) + 2, F.element_at(stops, t + 1) - F.element_at(stops, t) - 1)))
    text = F.when(F.col("__gone").isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    kept = [text.alias("text") if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    n_lines = F.when(docs["text"].isNull(), 0).otherwise(F.length(docs["text"]) - F.length(F.replace(docs["text"], F.lit("\n"), F.lit(""))) + 1)
    return both.select(*kept, n_lines.cast("long").alias("n_lines"), F.coalesce(F.array_size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
