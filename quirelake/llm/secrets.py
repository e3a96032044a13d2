"""Secret scan: fixed patterns, plus strings that a randomness battery takes for keys.

Native: everything is DataFrame expressions.  Matches get their places by marking
them in the text with two control characters and summing the lengths of the parts,
by doubling steps, so that a text of many spans takes little more than its length.

Base spans come from three patterns (assignments, access keys, hex runs).  The
battery looks at every maximal run of key characters that has digits or mixed
case.  The smallest alphabet that holds the run is its encoding.  Against the
hypothesis "words of a text" it measures how much more even the characters are
(chi-squared against the uniform law) and how much oftener the character class
changes (runs test); both as normal deviates for the run's length, joined to one
p-value.  Serial correlation and the chi-squared test against uniformity veto what
is no random string (counters, repeated blocks).  The Benjamini-Hochberg rule
decides in each stratum of encoding and length by itself, so that many short runs
do not let long ones through, nor the reverse; p-values are counted on a fixed
logarithmic grid over all documents, whose edges serve as thresholds.

Defined cases: null or empty texts have no spans; places are code points; equal
documents are scanned each; other columns are ignored; a text of any length is
scanned whole; an empty table gives an empty result.  Only the thresholds, a table
bounded by encodings x length classes, reach the driver.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: Encodings from the smallest alphabet up; the first that holds a run is taken.
ENCODINGS = {
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "BASE36": string.digits + string.ascii_uppercase,
    "base62": string.digits + string.ascii_letters,
    "base64": string.digits + string.ascii_letters + "+/",
    "base64url": string.digits + string.ascii_letters + "-_",
    "mixed": string.digits + string.ascii_letters + "+/-_",
}
#: Of texts: how much likelier than by chance two characters are equal; class changes a character.
EXCESS, CHANGES = 0.7, 0.1
VETO, GRID, LOWEST = 3.3, 8, 16

#: An array holds fewer than 2^STEPS elements.
STEPS = 31


def _running(x: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under ``join``, in log2(size) passes: no pass copies what another has built."""

    def step(x: Column, k: int) -> Column:
        whole = F.array(x)
        return F.get(F.transform(whole, lambda v: F.when(F.size(v) > 1 << k, F.transform(v, lambda y, i: F.when(i < 1 << k, y).otherwise(join(F.get(v, i - (1 << k)), y)))).otherwise(v)), F.lit(0))

    for k in range(STEPS):
        x = step(x, k)
    return x


def _found(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (start, end, match) of all matches, leftmost first and disjoint."""
    parts = F.split(F.regexp_replace(text, pattern, "\u0001$0\u0002"), "[\u0001\u0002]", -1)

    def spans(parts: Column) -> Column:
        ends = _running(F.transform(parts, lambda p: F.length(p)), lambda a, b: a + b)
        return F.get(F.transform(F.array(ends), lambda e: F.filter(F.transform(parts, lambda p, i: span(p, i, e)), lambda s: s.isNotNull())), F.lit(0))

    def span(part: Column, i: Column, ends: Column) -> Column:
        return F.when(i % 2 == 1, F.struct((F.get(ends, i) - F.length(part)).alias("a"), F.get(ends, i).alias("b"), part.alias("s")))

    none = F.array().cast("array<struct<a:int,b:int,s:string>>")
    return F.when(hint, F.get(F.transform(F.array(parts), spans), F.lit(0))).otherwise(none)


def _free(runs: Column, base: Column) -> Column:
    """The runs that overlap no base span: before the end of a run, no base span begins that ends behind its start."""
    starts = F.transform(base, lambda s: F.struct(s["a"].alias("at"), F.lit(1).alias("o"), s["b"].alias("end"), F.lit(None).cast("struct<a:int,b:int,s:string>").alias("run")))
    asked = F.transform(runs, lambda m: F.struct(m["b"].alias("at"), F.lit(0).alias("o"), F.lit(0).alias("end"), m.alias("run")))
    events = F.array_sort(F.concat(starts, asked))

    def kept(e: Column) -> Column:
        ends = _running(F.transform(e, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        clear = lambda x, i, r: F.when(x["run"].isNotNull() & (F.get(r, i) <= x["run"]["a"]), x["run"])
        return F.get(F.transform(F.array(ends), lambda r: F.filter(F.transform(e, lambda x, i: clear(x, i, r)), lambda m: m.isNotNull())), F.lit(0))

    return F.when(F.size(base) == 0, runs).when(F.size(runs) == 0, runs).otherwise(F.get(F.transform(F.array(events), kept), F.lit(0)))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), Abramowitz and Stegun 26.2.17."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _battery(run: Column) -> Column:
    """struct(stratum, p) of a run; every step passes over the run once, or once for each character of its alphabet."""
    alphabets = F.array(*[F.lit(a) for a in ENCODINGS.values()])
    names = F.array(*[F.lit(n) for n in ENCODINGS])
    first = F.coalesce(*[F.when(F.length(F.translate(run, a, "")) == 0, F.lit(i)) for i, a in enumerate(ENCODINGS.values())])

    def encoded(e: Column) -> Column:
        return _let(F.struct(F.get(names, e).alias("name"), F.get(alphabets, e).alias("alphabet"), F.length(run).cast("double").alias("n")), tested)

    def tested(r: Column) -> Column:
        stratum = F.concat_ws(":", r["name"], F.floor(F.log2(r["n"]) * 2).cast("string"))
        places = F.transform(F.filter(F.split(run, ""), lambda c: F.length(c) > 0), lambda c: F.instr(r["alphabet"], c).cast("double"))
        serial = _let(places, lambda x: _let(_total(x) / r["n"], lambda mean: _serial(x, mean, r["n"])))
        return _let(_evenness(run, r["alphabet"], r["n"]), lambda e: F.struct(stratum.alias("stratum"), _p_value(e, _brokenness(run, r["n"]), serial).alias("p")))

    return _let(first, encoded)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _serial(x: Column, mean: Column, n: Column) -> Column:
    """Size of the lag-one correlation of alphabet places, as a normal deviate; large for a constant."""
    lagged = _total(F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: (a - mean) * (b - mean)))
    return _let(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), lambda spread: F.when(spread > 0, F.abs(lagged / spread) * F.sqrt(n)).otherwise(F.lit(99.0)))


def _evenness(run: Column, alphabet: Column, n: Column) -> Column:
    """Deviates of the chi-squared statistic: above the uniform law, and below that of text."""
    counts = F.transform(F.split(alphabet, ""), lambda c: n - F.length(F.replace(run, c, F.lit(""))))
    size = F.length(alphabet).cast("double")
    chi = size * F.aggregate(counts, F.lit(0.0), lambda a, v: a + v * v) / n - n
    as_text = (size - 1) + (n - 1) * EXCESS
    return _let(chi, lambda c: F.struct(((c - (size - 1)) / F.sqrt(2 * (size - 1))).alias("uneven"), ((as_text - c) / F.sqrt(2 * (size - 1) + 4 * (n - 1) * EXCESS)).alias("even")))


def _brokenness(run: Column, n: Column) -> Column:
    """How much oftener than in text the class of characters changes, as a deviate."""
    classes = F.translate(run, string.digits + string.ascii_lowercase + string.ascii_uppercase + "+/-_", "0" * 10 + "a" * 26 + "A" * 26 + "-" * 4)
    for c in "0aA-":  # one character for each stretch of a class
        classes = F.regexp_replace(classes, f"{c}{{2,}}", c)
    usual = (n - 1) * CHANGES
    return (F.length(classes) - 1 - usual) / F.sqrt(usual + 1)


def _p_value(evenness: Column, broken: Column, serial: Column) -> Column:
    veto = (evenness["uneven"] > VETO) | (serial > VETO)
    return F.when(veto, F.lit(1.0)).otherwise(_let((evenness["even"] + broken) / F.sqrt(F.lit(2.0)), _upper_tail))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rate: float = 0.01) -> DataFrame:
    """One row for each document: ``doc_id``, ``base`` and ``random`` spans.

    A span is (start, kind number in KINDS, end).  ``rate`` bounds the expected
    share of false random spans in each stratum.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    body = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\u0001\u0002", "\u0003\u0003")
    low = F.lower(body)
    word = F.lit(False)
    for term in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        word = word | F.contains(low, F.lit(term))
    spans = docs.select(
        F.col(key).alias("doc_id"),
        F.filter(_found(body, ASSIGN, word), lambda m: F.length(F.regexp_extract(m["s"], ASSIGN, 2)) >= 6).alias("assign"),
        _found(body, ACCESS, F.contains(body, F.lit("AKIA"))).alias("access"),
        _found(body, HEX, F.lit(True)).alias("hex"),
        F.filter(_found(body, RANDOM, F.lit(True)), lambda m: m["s"].rlike("[0-9]|[a-z][A-Z]|[A-Z]{2}.*[a-z]")).alias("runs"),
    )
    spans = scratch.table(spans, "spans")

    def plain(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(m["a"].alias("a"), F.lit(KINDS.index(kind)).alias("k"), m["b"].alias("b")))

    def tested(m: Column) -> Column:
        return _let(_battery(m["s"]), lambda t: F.struct(m["a"].alias("a"), m["b"].alias("b"), t["stratum"].alias("stratum"), t["p"].alias("p")))

    base = F.concat(plain("assign"), plain("access"), plain("hex"))
    tests = spans.select("doc_id", F.array_sort(base).alias("base"), "runs")
    tests = tests.select("doc_id", "base", F.transform(_free(F.col("runs"), F.col("base")), tested).alias("tests"))
    tests = scratch.table(tests, "tests")

    step = F.least(F.floor(-F.log10(F.greatest(F.col("t.p"), F.lit(10.0 ** -LOWEST))) * GRID), F.lit(LOWEST * GRID))
    counts = tests.select(F.explode("tests").alias("t")).groupBy(F.col("t.stratum").alias("stratum"), step.alias("step")).count().collect()
    limits = _limits([(r["stratum"], r["step"], r["count"]) for r in counts], rate)
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else None
    chosen = F.filter("tests", lambda t: F.coalesce(t["p"] <= F.element_at(table, t["stratum"]), F.lit(False))) if limits else F.filter("tests", lambda t: F.lit(False))
    random = F.transform(chosen, lambda t: F.struct(t["a"].alias("a"), F.lit(KINDS.index("random")).alias("k"), t["b"].alias("b")))
    return tests.select("doc_id", "base", random.alias("random"))


def _limits(counts: list[tuple[str, int, int]], rate: float) -> dict[str, float]:
    """Per stratum the largest grid edge e with e <= rate * (p-values <= e) / all."""
    strata: dict[str, dict[int, int]] = {}
    for stratum, step, n in counts:
        strata.setdefault(stratum, {})[step] = n
    limits = {}
    for stratum, by_step in strata.items():
        total, below = sum(by_step.values()), 0
        for step in sorted(by_step, reverse=True):  # from the smallest p-values up
            below += by_step[step]
            edge = 10.0 ** (-step / GRID)
            if edge <= rate * below / total:
                limits[stratum] = edge
    return limits


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["a"].cast("string"), s["b"].cast("string"))))
