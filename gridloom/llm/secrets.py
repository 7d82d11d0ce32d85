"""Secret scans in DataFrame operations only: fixed patterns, then a randomness battery over the remaining long tokens.

Patterns (kinds ``assign``, ``access``, ``hex``) are matched leftmost and without overlap in every whole text. Every further run of
20 or more token characters that touches no pattern span is a candidate. Its encoding is inferred (ENCODINGS) and its symbols are numbered in that alphabet. The battery:

* Against "uniform over the alphabet": chi-squared of the symbol counts (Wilson-Hilferty, both tails: a cycle is too even), the runs test about
  the middle of the alphabet, and the lag-1 serial correlation. If the Bonferroni minimum of the four p-values is under GATE, the token is not random.
* Against "not random": text in that alphabet repeats symbols with at least the encoding's ``coincidence``, so chi-squared has at least that noncentrality, in proportion to the
  length. The token's p-value is the chance of so small a chi-squared then (Patnaik's approximation); it falls with the length of a random token, and short tokens have little power.

Discoveries are controlled within bands of length, since the share of random tokens changes with length: Benjamini-Hochberg at ``fdr`` over the p-values of all candidates of a band
in all documents. They are counted as a table of bands by p-value bins, whose size is fixed; a bin stands for its largest p-value. The p-values are analytic, so a key is found in a table of any size.

All work is linear in a text's length, for one long token, too. Defined results: a null text counts as empty; each row of the input gives one row, repeated ones
too; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Scratch

#: Fixed values of the base scan.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
LEAST = 20
BANDS = 8
#: Bins of p-values, ten for each power of ten.
BINS = 160
FDR = 0.05
#: Least combined p-value under randomness.
GATE = 0.001

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (pattern of the token without padding, alphabet, least chance that two symbols of text are equal), first match wins. Letters of running text
#: have 0.065 to 0.08; mixed with digits and upper case less. For alphabets of up to 16 symbols: twice the uniform chance.
ENCODINGS = (
    ("^[0-9]+$", DIGITS, 0.2),
    ("^[0-9a-f]+$", "0123456789abcdef", 0.125),
    ("^[0-9A-F]+$", "0123456789ABCDEF", 0.125),
    ("^[a-z]+$", LOWER, 0.062),
    ("^[A-Z]+$", UPPER, 0.062),
    ("^[A-Z2-7]+$", UPPER + "234567", 0.055),
    ("^[0-9a-z]+$", DIGITS + LOWER, 0.055),
    ("^[0-9A-Z]+$", DIGITS + UPPER, 0.055),
    ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.05),
    ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.05),
    ("", UPPER + LOWER + DIGITS + "+/-_=", 0.05),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is made once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(xs: Column, op: Callable[[Column, Column], Column] = lambda a, x: a + x, block: int = 256) -> Column:
    """Inclusive running fold of an array of longs by an associative operation, in blocks, so that long arrays are not copied for each element."""

    def folds(a: Column) -> Column:
        return F.aggregate(a, F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(op(F.get(acc, F.size(acc) - 1), x), x))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: folds(F.slice(xs, b * block + 1, F.lit(block))))
    ends = lambda inner: folds(F.transform(inner, lambda a: F.element_at(a, -1)))
    shifted = let(blocks, lambda inner: let(ends(inner), lambda e: F.flatten(F.transform(inner, lambda a, b: F.when(b == 0, a).otherwise(F.transform(a, lambda v: op(F.get(e, b - 1), v)))))))
    return F.when(F.size(xs) > 0, shifted).otherwise(F.array().cast("array<long>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, g) for the leftmost non-overlapping matches: code points, end exclusive; g is the group's text."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,g:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    ends = running(steps)
    spans = F.zip_with(F.arrays_zip(ends.alias("e"), found.alias("m")), groups, lambda z, g: F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), g.alias("g")))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for the normal distribution after Boerjesson and Sundberg; relative error under 0.3 %."""
    x = F.greatest(F.least(F.abs(z), F.lit(36.0)), F.lit(0.0))
    tail = F.exp(-x * x / 2) / ((0.661 * x + 0.339 * F.sqrt(x * x + 5.51)) * 2.5066282746310002)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _chi_z(x: Column, df: Column) -> Column:
    """A chi-squared value as a normal deviate (Wilson-Hilferty)."""
    spread = 2 / (9 * df)
    return (F.cbrt(F.greatest(x, F.lit(0.0)) / df) - (1 - spread)) / F.sqrt(spread)


def _counted(values: Column) -> Column:
    """Sum over the symbols of the square of their count, in one pass over the sorted numbers."""
    zero = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    same = lambda a, x: F.struct(x.alias("at"), F.when(a["at"] == x, a["run"] + 1).otherwise(1.0).alias("run"), F.when(a["at"] == x, a["total"] + 2 * a["run"] + 1).otherwise(a["total"] + 1).alias("total"))
    return F.aggregate(F.sort_array(values), zero, same, lambda a: a["total"])


def _walked(values: Column, k: Column) -> Column:
    """high (symbols of the upper half), runs (changes of half) and lag (sum of neighbours' products about the middle), in one pass."""
    zero = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("high"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("lag"))

    def step(a: Column, x: Column) -> Column:
        up = x >= k / 2
        return F.struct(
            x.alias("at"), (a["high"] + up.cast("double")).alias("high"), (a["changes"] + F.coalesce((up != (a["at"] >= k / 2)).cast("double"), F.lit(0.0))).alias("changes"),
            (a["lag"] + F.coalesce((a["at"] - (k - 1) / 2) * (x - (k - 1) / 2), F.lit(0.0))).alias("lag"),
        )

    return F.aggregate(values, zero, step)


def battery(token: Column) -> Column:
    """(random, text): the combined p-value under randomness, and the p-value under "not random" (1 for a token whose first value is under GATE)."""

    def encoded(bare: Column) -> Column:
        which = F.lit(len(ENCODINGS) - 1)
        for n, (pattern, _, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
            which = F.when(bare.rlike(pattern), F.lit(n)).otherwise(which)
        return let(which, lambda e: numbered(bare, e))

    def numbered(bare: Column, e: Column) -> Column:
        alphabets = F.array(*[F.lit(symbols) for _, symbols, _ in ENCODINGS])
        sizes = F.array(*[F.lit(float(len(symbols))) for _, symbols, _ in ENCODINGS])
        chance = F.array(*[F.lit(c) for _, _, c in ENCODINGS])
        values = let(F.element_at(alphabets, e + 1), lambda a: F.filter(F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.instr(a, c) - 1), lambda v: v >= 0))
        return let(F.struct(values.alias("v"), F.element_at(sizes, e + 1).alias("k"), F.element_at(chance, e + 1).alias("c")), measured)

    def measured(s: Column) -> Column:
        return let(F.struct(F.size(s["v"]).cast("double").alias("n"), s["k"].alias("k"), s["c"].alias("c"), _counted(s["v"]).alias("squares"), _walked(s["v"], s["k"]).alias("w")), tested)

    def tested(m: Column) -> Column:
        n, k, w = m["n"], m["k"], m["w"]
        chi = k / n * m["squares"] - n
        z = _chi_z(chi, k - 1)
        mean = 2 * w["high"] * (n - w["high"]) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(var > 0, 2 * _upper_tail(F.abs(w["changes"] + 1 - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)
        p_serial = 2 * _upper_tail(F.abs(w["lag"] / ((k * k - 1) / 12)) / F.sqrt(n - 1))
        random = F.least(F.lit(1.0), 4 * F.least(_upper_tail(z), _upper_tail(-z), p_runs, p_serial))
        df, shift = k - 1, n * (k * m["c"] - 1)
        scale = (df + 2 * shift) / (df + shift)
        text = _upper_tail(-_chi_z(chi / scale, (df + shift) / scale))
        return F.when(n >= 2, F.struct(random.alias("random"), F.when(random >= GATE, text).otherwise(1.0).alias("text"))).otherwise(F.struct(F.lit(0.0).alias("random"), F.lit(1.0).alias("text")))

    return let(F.rtrim(token, F.lit("=")), encoded)


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def apart(more: Column, base: Column) -> Column:
    """Those of the spans ``more`` that overlap none of ``base``; both may hold many, so starts are merged in one order and looked at once."""
    least, most = -(1 << 62), 1 << 62
    marks = F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(0).alias("side"), b["end"].alias("end"), F.lit("").alias("g"))),
        F.transform(more, lambda m: F.struct(m["start"].alias("at"), F.lit(1).alias("side"), m["end"].alias("end"), m["g"].alias("g"))),
    ))
    #: Furthest end of a base span that starts before, and the next start of one.
    ends = lambda e: running(F.transform(e, lambda x: F.when(x["side"] == 0, x["end"]).otherwise(F.lit(least))), F.greatest)
    starts = lambda e: F.reverse(running(F.reverse(F.transform(e, lambda x: F.when(x["side"] == 0, x["at"]).otherwise(F.lit(most)))), F.least))
    near = lambda e: F.arrays_zip(e.alias("x"), ends(e).alias("reach"), starts(e).alias("next"))
    kept = F.filter(let(marks, near), lambda z: (z["x"]["side"] == 1) & (z["reach"] <= z["x"]["at"]) & (z["next"] >= z["x"]["end"]))
    free = F.transform(kept, lambda z: F.struct(z["x"]["at"].alias("start"), z["x"]["end"].alias("end"), z["x"]["g"].alias("g")))
    return F.when((F.size(more) > 0) & (F.size(base) > 0), free).otherwise(more)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and candidates (start, end, band, bin of the p-value under "not random") of each row of docs(doc_id, text)."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = F.filter(matches(F.col("text"), ASSIGN, 2), lambda m: F.length(m["g"]) >= MIN_ASSIGNED)
    t = t.select("doc_id", "text", kept.alias("assign"), matches(F.col("text"), ACCESS).alias("access"), matches(F.col("text"), HEX).alias("hex"))
    t = t.select("doc_id", "text", F.array_sort(F.concat(*[_of_kind(F.col(k), n) for n, k in enumerate(KINDS[:3])])).alias("base"))
    t = t.select("doc_id", "base", matches(F.col("text"), CANDIDATE).alias("more"))
    t = t.select("doc_id", "base", apart(F.col("more"), F.col("base")).alias("more"))
    band = lambda m: F.least(F.floor(2 * F.log2((m["end"] - m["start"]) / LEAST)), F.lit(BANDS - 1)).cast("int")
    place = lambda p: F.greatest(F.least(F.floor(-10 * F.log10(p)), F.lit(BINS)), F.lit(0)).cast("int")
    scored = F.transform("more", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), band(m).alias("band"), place(battery(m["g"])["text"]).alias("bin")))
    return t.select("doc_id", "base", scored.alias("more"))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Length band to the least bin that the band's Benjamini-Hochberg procedure rejects at; bands without one are left out."""
    cells = scanned.select(F.explode("more").alias("m")).groupBy("m.band", "m.bin").count().collect()  # BANDS by BINS rows at most
    least = {}
    for band in range(BANDS):
        above = [sum(c["count"] for c in cells if c["band"] == band and c["bin"] >= t) for t in range(BINS + 1)]
        for t, n in enumerate(above):
            if n and 10 ** (-t / 10) * above[0] <= fdr * n:
                least[band] = t
                break
    return least


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """A row for each of docs(doc_id, text): doc_id, counts by kind, base_sha256, spans ("kind:start:end,...")."""
    scanned = Scratch(scan(docs), "secrets").df
    least = thresholds(scanned, fdr)
    limit = F.array(*[F.lit(least.get(b, BINS + 1)) for b in range(BANDS)])
    random = _of_kind(F.filter("more", lambda m: m["bin"] >= F.element_at(limit, m["band"] + 1)), 3)
    of = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return scanned.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.size(random).cast("long").alias("n_random"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", random))).alias("spans"),
    )
