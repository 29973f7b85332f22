"""Secrets in texts: fixed patterns, and a battery of randomness tests, DataFrame functions only.

Patterns: see ``KINDS``.  Positions come without a loop over the text: the
pieces that ``split`` leaves and the matches that ``regexp_extract_all`` gives
take turns, so running sums of their lengths are the positions (code points).

Battery: every maximal run of 20 or more characters of ``[A-Za-z0-9+/_-]`` with
its final padding (18 or more without it, so that a heading's underline is
none; any other ``=`` ends a run, so that a name is not tested with its value),
and of a run with slashes every part as long between them, that touches no
pattern's span, is tested for being uniform and independent over the alphabet
of its encoding (hex, base32, base62, base64) or else of the kinds of
characters it uses:
chi-squared of the alphabet in as many bins as its length allows (five or more
expected in each, 16 bins at most), runs above and below the alphabet's
middle, and serial correlation of neighbours.  Simes' rule joins the three.
Benjamini and Hochberg's rule over the whole table, weighted by length (long
runs have the power to be told apart, so they may claim more of the level),
finds the runs that are *not* random; the others are spans of kind ``random``
(parts only outside of such a run).  What touches or holds a span is told by
binary searches in sorted starts and ends, so a text of very many runs takes
time near their number.
Its threshold comes from a histogram of at most ``BINS`` bins.

Defined cases: null text is empty; no span gives empty lists; a row depends on
its own text and the table's one threshold, so repeated rows agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckscope.functions.mathx import erf

from .shared import col, stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group whose length counts, least length.  Runs that are maximal anyway take their least length into the pattern.
KINDS = (("assign", ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]{14,}", 0, 18), ("hex", "[0-9a-f]{16,}", 0, 16))
#: Final padding: '=' that no other run character follows; any other '=' ends a run.
PAD = "(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
RUN, RUN_MIN = "[A-Za-z0-9+/_-]{18,}" + PAD, 20
#: The parts of a run between slashes.
PART = f"(?:(?<=/)[A-Za-z0-9+_-]{{18,}}{PAD}|(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{{18,}}+(?=/))"
#: Least length without padding: 20 characters of base64 and 24 of base32 end on that many or more.
CORE_MIN = 18
LEVEL, BINS, BIN = 0.05, 2048, 32
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encoding: what it looks like, its alphabet in order.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    ("base32_lower", r"^(?=.*[2-7])(?=.*[a-z])[a-z2-7]+=*$", LOWER + "234567"),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
#: The rest is tested against the kinds of characters it uses (base36 is the second and third).  Letters stand by how
#: often texts have them, which is nothing to a random run, but words fill the first bins.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
USED = (("[A-Z]", COMMON.upper()), ("[a-z]", COMMON), ("[0-9]", DIGITS), ("[+]", "+"), ("/", "/"), ("_", "_"), ("-", "-"))


def _with_ends(df: DataFrame, name: str, lens: Column, block: int = 64) -> DataFrame:
    """Adds ``{name}_e``: for each length the sum of it and all before; blocks keep the work near the number of lengths.

    Each step is a column that later ones name twice or more, so that it is made once a row and not inside their lambdas.
    """
    zero, a, b, base = F.lit(0).cast("long"), col(f"{name}_a"), col(f"{name}_b"), col(f"{name}_c")
    add = lambda x: F.aggregate(x, zero, lambda s, y: s + y)
    df = df.withColumn(f"{name}_a", lens)
    df = df.withColumn(f"{name}_b", F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda k: add(F.slice(a, k * block + 1, block))))
    df = df.withColumn(f"{name}_c", F.transform(b, lambda x, k: add(F.slice(b, F.lit(1), k))))
    here = lambda i: F.floor(i / block).cast("int")
    return df.withColumn(f"{name}_e", F.when(F.size(base) > 0, F.transform(a, lambda x, i: F.get(base, here(i)) + add(F.slice(a, here(i) * block + 1, i % block + 1)))))


NO_SPANS = "array<struct<s:bigint,e:bigint,v:string>>"


def _with_spans(df: DataFrame, text: str, name: str, pattern: str, maybe: Column, group: int, least: int) -> DataFrame:
    """Adds the column ``name``: (s, e, v) of the matches in order; ``maybe`` false: none, and no further look at the text."""
    m, g, e = (col(f"{name}_{x}") for x in "mge")
    size = lambda x: F.char_length(x).cast("long")
    df = df.withColumn(f"{name}_m", F.when(maybe, F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))))
    if group:
        df = df.withColumn(f"{name}_g", F.when(F.size(m) > 0, F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))))
    df = _with_ends(df, name, F.when(F.size(m) > 0, F.zip_with(F.transform(F.split(col(text), pattern, -1), size), F.transform(m, size), lambda gap, n: gap + F.coalesce(n, F.lit(0).cast("long")))))
    every = F.transform(m, lambda x, i: F.struct((F.get(e, i) - size(x)).alias("s"), F.get(e, i).alias("e"), x.alias("v"), (F.char_length(F.get(g, i)) if group else F.char_length(x)).alias("n")))
    long_ones = F.transform(F.filter(every, lambda x: x["n"] >= least), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))
    df = df.withColumn(name, F.coalesce(F.when(F.size(e) > 0, long_ones), F.array().cast(NO_SPANS)))
    return df.drop(*(f"{name}_{x}" for x in "mgabce"))


def _with_sorted_ends(df: DataFrame, name: str, *spans: str) -> DataFrame:
    """Adds ``{name}_s`` and ``{name}_e``: starts and ends of the spans, each sorted."""
    both = F.concat(*spans)
    return df.withColumns({f"{name}_s": F.sort_array(F.transform(both, lambda k: k["s"])), f"{name}_e": F.sort_array(F.transform(both, lambda k: k["e"]))})


def _below(name: str, x: Column) -> Column:
    """How many of a sorted column of numbers are less than x: a binary search, so a span costs 31 looks however many there are."""
    steps = F.array(*(F.lit(1 << k).cast("long") for k in range(30, -1, -1)))
    fits = lambda at, k: (at + k <= F.size(name)) & (F.get(col(name), (at + k - 1).cast("int")) < x)
    return F.aggregate(steps, F.lit(0).cast("long"), lambda at, k: F.when(fits(at, k), at + k).otherwise(at))


def _tail(z: Column) -> Column:
    """The normal distribution's share above z, at least 1e-16."""
    return F.greatest(F.lit(1e-16), (1 - erf(z / F.lit(2.0 ** 0.5))) / 2)


def _tested(runs: Column) -> Column:
    """(s, e, n, p) of the runs: p joins the three tests by Simes' rule.

    Every step is a transform of the one before, so what it names is made once a run.
    """
    enc = lambda v: F.coalesce(*(F.when(v.rlike(look), F.lit(a)) for _, look, a in ENCODINGS), F.concat(*(F.when(v.rlike(look), F.lit(a)).otherwise("") for look, a in USED)))
    x = F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), F.rtrim(r["v"], F.lit("=")).alias("v"), enc(r["v"]).alias("abc")))
    x = F.filter(x, lambda r: r["v"].rlike("[A-Za-z0-9]") & (F.char_length(r["abc"]) > 1) & (F.char_length(r["v"]) >= CORE_MIN))  # so three bins or more, and no division by zero below
    x = F.transform(x, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), F.char_length(r["abc"]).cast("double").alias("size"), F.transform(
        F.filter(F.split(r["v"], ""), lambda ch: ch != ""), lambda ch: F.position(ch, r["abc"]) - 1.0).alias("codes")))
    bins = lambda r: F.least(F.lit(16.0), r["size"], F.floor(F.size(r["codes"]) / 5.0).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
    x = F.transform(x, lambda r: F.struct(
        r["s"].alias("s"), r["e"].alias("e"), r["size"].alias("size"), F.size(r["codes"]).cast("double").alias("n"),
        bins(r).alias("bins"),
        F.transform(r["codes"], lambda k: k / r["size"]).alias("u"),  # uniform on 0 to 1
        F.transform(r["codes"], lambda k: F.floor(k * bins(r) / r["size"])).alias("binned"),
        F.transform(r["codes"], lambda k: F.when(k * 2 >= r["size"], 1.0).otherwise(0.0)).alias("high"),
        (total(r["codes"]) / F.size(r["codes"])).alias("mean")))
    x = F.transform(x, lambda r: F.struct(
        r["s"].alias("s"), r["e"].alias("e"), r["n"].alias("n"), (r["bins"] - 1).alias("df"),
        # Pearson's sum: counts squared over the bins' expected shares; a bin holds as many values as there are whole codes in its range
        (total(F.transform(F.array_distinct(r["binned"]), lambda k: F.pow(F.size(F.filter(r["binned"], lambda y: y == k)).cast("double"), F.lit(2.0))
                           / (F.ceil((k + 1) * r["size"] / r["bins"]) - F.ceil(k * r["size"] / r["bins"])))) * r["size"] / r["n"] - r["n"]).alias("rough"),
        total(r["high"]).alias("n1"),
        (total(F.transform(r["high"], lambda k, i: F.when(F.get(r["high"], i - 1) != k, 1.0).otherwise(0.0))) + 1).alias("runs"),
        (total(F.transform(r["u"], lambda k: k)) / r["n"]).alias("m"), r["u"].alias("u")))
    x = F.transform(x, lambda r: F.struct(
        r["s"].alias("s"), r["e"].alias("e"), r["n"].alias("n"), r["df"].alias("df"),
        F.greatest(F.lit(0.0), r["rough"]).alias("chi"), r["n1"].alias("n1"), r["runs"].alias("runs"),
        total(F.transform(r["u"], lambda k: (k - r["m"]) * (k - r["m"]))).alias("var"),
        total(F.transform(r["u"], lambda k, i: F.coalesce((k - r["m"]) * (F.get(r["u"], i - 1) - r["m"]), F.lit(0.0)))).alias("lag")))

    def tests(r):
        wilson = (F.pow(r["chi"] / r["df"], F.lit(1 / 3)) - (1 - 2 / (9 * r["df"]))) / F.sqrt(2 / (9 * r["df"]))
        n1, n0 = r["n1"], r["n"] - r["n1"]
        mean = 2 * n1 * n0 / r["n"] + 1
        var = (mean - 1) * (mean - 2) / (r["n"] - 1)
        turns = F.when(var > 0, F.abs(r["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(8.0)
        serial = F.when(r["var"] > 0, F.abs(r["lag"] / F.greatest(r["var"], F.lit(1e-12))) * F.sqrt(r["n"])).otherwise(8.0)
        return F.sort_array(F.array(_tail(wilson), F.least(F.lit(1.0), 2 * _tail(turns)), F.least(F.lit(1.0), 2 * _tail(serial))))

    x = F.transform(x, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["n"].alias("n"), tests(r).alias("ps")))
    return F.transform(x, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["n"].alias("n"),
                                             F.least(F.lit(1.0), 3 * F.get(r["ps"], F.lit(0)), 1.5 * F.get(r["ps"], F.lit(1)), F.get(r["ps"], F.lit(2))).alias("p")))


def patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of ``docs``: ``doc_id``, the spans of each pattern, and the tested runs with their p."""
    df = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    low = F.lower("text")
    maybe = {"assign": low.rlike("password|passwd|secret|token|api_?key"), "access": F.col("text").contains("AKIA"), "hex": F.col("text").rlike("[0-9a-f]{16}")}
    for name, pattern, group, least in KINDS:
        df = _with_spans(df, "text", name, pattern, maybe[name], group, least)
    df = _with_spans(df, "text", "run", RUN, F.col("text").rlike("[A-Za-z0-9+/_-]{18}"), 0, RUN_MIN)
    df = _with_spans(df, "text", "part", PART, F.col("text").rlike("/[A-Za-z0-9+_-]{18}|[A-Za-z0-9+_-]{18}/"), 0, RUN_MIN)
    df = _with_sorted_ends(df, "known", *(k[0] for k in KINDS))
    # as many spans begin before a run's end as end up to its start: none touches it
    df = df.withColumn("fresh", F.filter(F.concat("run", "part"), lambda r: _below("known_s", r["e"]) == _below("known_e", r["s"] + 1)))
    slim = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k)
    return df.select("doc_id", *(slim(k[0]) for k in KINDS), _tested(col("fresh")).alias("runs"))


def threshold(found: DataFrame, level: float = LEVEL) -> tuple[float, float]:
    """(mean length of the tested runs, largest p over weight that is rejected as not random; 0: none is)."""
    runs = found.select(F.explode("runs").alias("r"))
    m, mean = runs.agg(F.count("*"), F.avg("r.n")).first()
    if not m:
        return 1.0, 0.0
    weighted = F.col("r.p") * mean / F.col("r.n")
    at = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(-F.log2(weighted) * BIN))).cast("int")
    most, below = 0.0, 0
    for row in runs.groupBy(at.alias("bin")).count().orderBy(F.col("bin").desc()).collect():  # at most BINS rows
        below += row["count"]
        if 2.0 ** (-row["bin"] / BIN) <= level * below / m:
            most = 2.0 ** (-row["bin"] / BIN)
    return mean, most


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """``doc_id``, ``spans``: array of (s, order, kind, e), by start and then kind; end exclusive."""
    found = stored(patterns(docs, id_col, text_col), "secrets")
    mean, most = threshold(found, level)
    label = lambda a, i, kind: F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("order"), F.lit(kind).alias("kind"), x["e"].alias("e")))
    found = found.withColumn("runs", F.filter("runs", lambda r: r["p"] * mean / r["n"] > most))
    found = _with_sorted_ends(found, "runs", "runs")
    # no parts of one that is there: runs are apart and parts lie in them apart, so what begins up to a span's start and has not ended before its end holds it
    random = F.filter("runs", lambda x: _below("runs_s", x["s"] + 1) - _below("runs_e", x["e"]) < 2)
    kinds = [label(F.col(k[0]), i, k[0]) for i, k in enumerate(KINDS)] + [label(random, len(KINDS), "random")]
    return found.select("doc_id", F.sort_array(F.concat(*kinds)).alias("spans"))
