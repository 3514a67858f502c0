"""Secret scans by a battery of randomness tests, in DataFrame functions only.

Base spans are those of three fixed patterns. Beyond them, every run of token
characters that is long enough is a candidate: its encoding is inferred (digits,
letters, hex, base32, base36, base64), its characters become numbers in that
alphabet, and four tests ask whether they look uniformly random: chi-squared
uniformity of the alphabet, runs about the middle of the alphabet, lag-one serial
correlation, and chi-squared of the mixture of lower case, upper case, digits and
signs against their shares of the alphabet (none if it has one kind of
character). Fisher's method combines their p-values; that of a random token is about
uniform in 0..1 (tested), that of ordinary text near 0.

What is reported is controlled: in each band of lengths, because the power of the
tests grows with the length, and over all candidates of the corpus. Of the
candidates above ``SURE`` as many per width of p as uniform ones would be are taken
for random; what lies above a threshold in excess of them are false discoveries.
The least threshold at which those are a share of ``ALPHA`` or less of what is reported
decides; a band without such a threshold reports nothing.

Positions come from the lengths of what lies between the matches, since SQL has
no function for them. The p-values are counted in bins of a hundredth of a
decade, so that what decides (a bin for each band) has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_of

#: Base kinds in the order they are listed: kind, pattern, group whose length counts, least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = (*(b[0] for b in BASE), "random")
#: Length bands of candidates: each ends before the next begins.
BANDS = (20, 24, 32, 40, 48, 64, 96)
ALPHA = 0.1
#: Bins of p, a hundredth of a decade each, from 1 downwards; those above SURE (p of 0.2) hold random tokens only, as far as can be told.
BINS, SURE = 1600, 70
#: Signs of padding at most at the end of base64.
PADDING = 2
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding: what the token consists of, and its alphabet in order.
ENCODINGS = (
    ("^[0-9]+$", DIGITS),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Za-z]+$", UPPER + LOWER),
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
)
ADDED = ("n_assign", "n_access", "n_hex", "spans")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """array<struct<s, k, e>> of the leftmost non-overlapping matches whose group has ``least`` characters, in code points."""
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")),
    )
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda between, m: F.struct(F.length(between).alias("b"), m["m"].alias("m"), m["g"].alias("g")))
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["b"]
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + x["m"]).alias("e"))
        return F.struct((start + F.coalesce(x["m"], F.lit(0))).alias("at"), F.when(x["g"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic approximation within 0.0002, never below 1e-12."""
    return F.greatest(F.lit(1e-12), 1 / (1 + F.exp(F.least(F.lit(30.0), 1.5976 * z + 0.07056 * z * z * z))))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def p_uniform(x: Column, size: Column) -> Column:
    """Chi-squared test of the counts of 0..size-1 in x against equal shares; its tail by the Wilson-Hilferty cube root."""
    n, df = F.size(x), (size - 1).cast("double")
    squares = F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), lambda a: F.size(F.filter(x, lambda v: v == a)).cast("double")), F.lit(0.0), lambda s, c: s + c * c)
    chi2 = squares * size / n - n
    spread = 2 / (9 * df)
    return _upper_tail((F.pow(F.greatest(chi2, F.lit(0.0)) / df, 1 / 3) - (1 - spread)) / F.sqrt(spread))


def p_runs(x: Column, size: Column) -> Column:
    """Wald-Wolfowitz test of the runs above and below the middle of the alphabet; 1e-12 if all are on one side."""
    n = F.size(x).cast("double")
    high = F.size(F.filter(x, lambda v: v * 2 >= size)).cast("double")
    runs = 1 + F.size(F.filter(F.sequence(F.lit(1), F.size(x) - 1), lambda i: (F.get(x, i) * 2 >= size) != (F.get(x, i - 1) * 2 >= size)))
    mean = 2 * high * (n - high) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return F.when(var > 0, _two_sided((runs - mean) / F.sqrt(F.when(var > 0, var)))).otherwise(1e-12)


def p_serial(x: Column) -> Column:
    """Test of the lag-one serial correlation of x; 1e-12 if x is constant."""
    n = F.size(x).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / n
    var = total(F.transform(x, lambda v: v.cast("double") * v)) - n * mean * mean
    lag = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda s, i: s + F.get(x, i) * F.get(x, i - 1))
    r = (lag - (n - 1) * mean * mean) / F.when(var > 1e-9, var)
    return F.when(var > 1e-9, _two_sided((r + 1 / n) * F.sqrt(n))).otherwise(1e-12)


def p_mixture(core: Column, alphabet: Column) -> Column:
    """Chi-squared test of the kinds of characters (lower, upper, digits, signs) against their shares of the alphabet; 1 if that has one kind."""
    kinds = F.array(*[F.lit(k) for k in ("[^a-z]", "[^A-Z]", "[^0-9]", "[A-Za-z0-9]")])
    n = F.length(core).cast("double")
    count = lambda t: F.transform(kinds, lambda k: F.length(F.regexp_replace(t, k, "")).cast("double"))
    shares = F.transform(count(alphabet), lambda c: c / F.length(alphabet))
    parts = F.zip_with(count(core), shares, lambda c, s: F.when(s > 0, (c - n * s) * (c - n * s) / (n * s)).otherwise(0.0))
    chi2 = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    df = (F.size(F.filter(shares, lambda s: s > 0)) - 1).cast("double")
    spread = 2 / (9 * F.greatest(df, F.lit(1.0)))
    p = _upper_tail((F.pow(chi2 / F.greatest(df, F.lit(1.0)), 1 / 3) - (1 - spread)) / F.sqrt(spread))
    return F.when(df > 0, p).otherwise(1.0)


def battery(token: Column) -> Column:
    """The combined p-value of a token's randomness, or null where it has no encoding or is too short without its padding."""

    def combined(ps: list[Column], mixed: Column) -> Column:
        half = -sum((F.log(p) for p in ps[1:]), F.log(ps[0]))  # half of Fisher's chi-squared with two degrees of freedom a test
        last = F.when(mixed, half * half * half / 6).otherwise(0.0)
        return F.exp(-half) * (1 + half + half * half / 2 + last)

    def tests(core: Column) -> Column:
        alphabet = F.coalesce(*[F.when(core.rlike(p), F.lit(a)) for p, a in ENCODINGS])
        numbers = F.transform(F.split(core, ""), lambda c: F.instr(alphabet, c) - 1)
        p = _bind(numbers, lambda x: _bind(F.length(alphabet), lambda a: combined([p_uniform(x, a), p_runs(x, a), p_serial(x), p_mixture(core, alphabet)], ~alphabet.isin(DIGITS, LOWER, UPPER))))
        return F.when(alphabet.isNotNull() & (F.length(core) >= BANDS[0] - PADDING), p)

    return _bind(F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", ""), tests)


def candidates(text: Column) -> Column:
    """array<struct<s, e, band, p>> of the text's candidates."""
    spans = matches(text, CANDIDATE, 0, BANDS[0], len(KINDS))
    band = lambda n: sum(((n >= b).cast("int") for b in BANDS[1:]), F.lit(0))
    tokens = F.zip_with(spans, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda a, t: F.struct(a["s"].alias("s"), a["e"].alias("e"), band(a["e"] - a["s"]).alias("band"), battery(t).alias("p")))
    return F.when(text.rlike(CANDIDATE), F.filter(tokens, lambda c: c["p"].isNotNull())).otherwise(F.array().cast("array<struct<s:int,e:int,band:int,p:double>>"))


def bin_of(p: Column) -> Column:
    return F.least(F.lit(BINS), F.ceil(-100 * F.log10(p)))


def thresholds(scanned: DataFrame) -> dict[int, int]:
    """Of each length band the last bin that is reported (bands without one: none is). At most len(BANDS) rows."""
    counts = scanned.select(F.explode("cands").alias("c")).select("c.band", bin_of(F.col("c.p")).alias("bin")).groupBy("band", "bin").count()
    upward = Window.partitionBy("band").orderBy("bin")  # BINS rows a band at most
    ranked = counts.select("band", "bin", F.sum("count").over(upward).alias("reported"), F.sum(F.when(F.col("bin") <= SURE, F.col("count")).otherwise(0)).over(Window.partitionBy("band")).alias("sure"))
    width = lambda b: 1 - F.pow(F.lit(10.0), -b / 100)  # noqa: E731  of p from a bin's end to 1
    false = F.greatest(F.lit(0.0), F.col("reported") - F.col("sure") * width(F.col("bin")) / width(F.lit(float(SURE))))
    rows = ranked.filter(false <= ALPHA * F.col("reported")).groupBy("band").agg(F.max("bin").alias("bin")).collect()
    return {r.band: r.bin for r in rows}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with assign, access, hex (array<struct<s, k, e>>) and cands, all in code points of the whole text."""
    t = text_of(text)
    df = docs.withColumns({kind: matches(t, pattern, group, least, k) for k, (kind, pattern, group, least) in enumerate(BASE, 1)})
    return df.withColumn("cands", candidates(t))


def with_spans(scanned: DataFrame) -> DataFrame:
    """A stored scan with base and all: sorted array<struct<s, k, e>>; all adds the candidates that are reported and touch no base span."""
    cut_at = thresholds(scanned)
    limits = F.array(*[F.lit(cut_at.get(b, -1)) for b in range(len(BANDS))])
    df = scanned.withColumn("base", F.array_sort(F.concat(*[b[0] for b in BASE])))

    def stays(c: Column) -> Column:
        return (bin_of(c["p"]) <= F.element_at(limits, c["band"] + 1)) & ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    more = F.transform(F.filter("cands", stays), lambda c: F.struct(c["s"].alias("s"), F.lit(len(KINDS)).alias("k"), c["e"].alias("e")))
    return df.withColumn("all", F.array_sort(F.concat("base", more)))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, n_assign, n_access, n_hex and secrets, array<struct<kind, start, end>>, in order.

    Null and empty texts have none; repeated rows each come back with the same spans; an empty table gives an empty result.
    """
    df = with_spans(cut(scan(docs.select(id_col, text), text).drop(text)))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform("all", lambda x: F.struct(F.element_at(kinds, x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end")))
    return df.select(id_col, *[F.size(b[0]).cast("long").alias(f"n_{b[0]}") for b in BASE], spans.alias("secrets"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    df = with_spans(cut(scan(docs.select("doc_id", "text")).drop("text")))
    return df.select("doc_id", *[F.size(b[0]).cast("long").alias(f"n_{b[0]}") for b in BASE], F.sha2(F.encode(listed("base"), "UTF-8"), 256).alias("base_sha256"), listed("all").alias("spans"))
