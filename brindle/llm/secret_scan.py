"""Secret scans with DataFrame functions only: fixed patterns, then a randomness test battery.

Base spans come from three patterns (assign, access, hex). The battery looks at longer tokens
that hold a digit and a letter: their encoding is inferred from their letters (hex, base32 or
base64 alphabet). Against the hypothesis that a token is text, each of three tests gives a
p-value: the chi-squared statistic of uniformity over that alphabet is smaller than that of text,
the runs of letter classes are more, the lag-1 serial correlation is lower. Fisher's method
combines the three. A token that the same statistics set apart from random letters, too (any of
chi-squared, runs about the alphabet's middle, serial correlation by more than ``DEVIATION``
standard units), has the p-value 1. All tokens of all documents then go through
Benjamini-Hochberg control of false discoveries within each length class (from a histogram of the
p-values, of fixed size). Discoveries that touch no base span are added as kind ``random``.

Spans are code points, end exclusive. Null and empty texts have no spans and the digest of the
empty text; very long texts are scanned whole. Repeated rows are each scanned; an empty table
gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import written

# The patterns of the base kinds and the least length of what they hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are taken whole, so the 20 letters in all can stand in the pattern
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
# A token stands after any letter that it cannot hold itself, '=' included; '=' is padding only where no further token follows.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_-]))?"

#: Allowed share of false discoveries; largest deviation, in standard units, of the three randomness tests.
FDR, DEVIATION = 0.01, 3.3
#: Under the text hypothesis: chance that two letters agree, chance that neighbours change class, serial correlation.
AGREE, CHANGE, SERIAL = 0.065, 0.15, 0.2
#: Width of the histogram's bins in log p, and their number (the last holds all beyond); length classes are powers of two.
BIN, BINS = 0.25, 4000
#: Code points of the pieces that a text to be masked is cut into.
CHUNK = 4096
_PART = 256


def _spans(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add ``name``: array of (start, end, token) of all matches, in order."""
    found, parts, steps = f"_{name}_m", f"_{name}_p", f"_{name}_d"
    some = F.size(found) > 0
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    df = df.withColumn(found, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn(parts, F.when(some, F.split("text", pattern, -1)))
    # What stands before each match and after the one before; nothing is looked up by place, as the optimizer may put the split inside such a lookup.
    before = F.concat(F.array(F.lit("")), found)
    df = df.withColumn(steps, F.when(some, F.zip_with(parts, before, lambda p, m: (F.char_length(p) + F.char_length(m)).cast("long")))).drop(parts)
    # Prefix sums in two levels, so that a text with very many matches costs no square of them.
    df = df.withColumn("_b", F.transform(F.sequence(F.lit(0), F.expr(f"int((size({found}) - 1) div {_PART})")), lambda b: total(F.slice(F.col(steps), b * _PART + 1, F.lit(_PART)))))
    df = df.withColumn("_before", F.transform("_b", lambda _, b: total(F.slice(F.col("_b"), F.lit(1), b))))
    start = lambda i: F.get(F.col("_before"), (i / _PART).cast("int")) + total(F.slice(F.col(steps), i - i % _PART + 1, i % _PART + 1))
    spans = F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.char_length(m)).alias("end"), m.alias("token")))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,token:string>>)")
    return df.withColumn(name, F.when(some, spans).otherwise(empty)).drop(found, steps, "_b", "_before")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once, however often the body looks into it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _counts(token: Column) -> Column:
    """How often each distinct letter stands in ``token``."""
    return F.transform(F.array_distinct(F.split(token, "")), lambda c: (F.char_length(token) - F.char_length(F.replace(token, c, F.lit("")))).cast("double"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _tail(z: Column) -> Column:
    """log of the upper normal tail beyond z (Chernoff form; 0 at and below the middle)."""
    return F.when(z > 0, -z * z / 2 - F.log(1 + z * math.sqrt(math.pi / 2))).otherwise(F.lit(0.0))


def _tested(tokens: DataFrame) -> DataFrame:
    """For rows with a column ``token``: log of the combined p-value of its being text, and length class."""
    t = F.regexp_replace("token", "=+$", "")
    alphabet = (
        F.when(F.col("body").rlike("^[0-9a-f]+$"), F.lit(_DIGIT + "abcdef"))
        .when(F.col("body").rlike("^[0-9A-F]+$"), F.lit(_DIGIT + "ABCDEF"))
        .when(F.col("body").rlike("^[A-Z2-7]+$"), F.lit(_UPPER + "234567"))
        .when(F.col("body").rlike("^[a-z0-9]+$"), F.lit(_DIGIT + _LOWER))
        .when(F.col("body").rlike("^[A-Z0-9]+$"), F.lit(_DIGIT + _UPPER))
        .when(F.col("body").rlike("[+/_-]"), F.lit(_UPPER + _LOWER + _DIGIT + "+/-_"))
        .otherwise(F.lit(_UPPER + _LOWER + _DIGIT))
    )
    df = tokens.withColumn("body", t).withColumn("alphabet", alphabet)
    df = df.withColumn("n", F.char_length("body").cast("double")).withColumn("size", F.char_length("alphabet").cast("double"))
    df = df.withColumn("letters", F.split("body", "")).withColumn("codes", F.transform("letters", lambda c: (F.call_function("instr", F.col("alphabet"), c) - 1).cast("double")))
    df = df.withColumn("squares", _sum(F.transform(_counts(F.col("body")), lambda c: c * c)))
    mean = _sum(F.col("codes")) / F.col("n")
    df = df.withColumn("mean", mean)
    n = F.col("n")
    high = lambda v: (v >= F.col("size") / 2).cast("double")
    kind = F.transform("letters", lambda c: F.when(c.rlike("[0-9]"), 1).when(c.rlike("[A-Z]"), 2).when(c.rlike("[a-z]"), 3).otherwise(4))
    pairs = F.sequence(F.lit(0), F.size("letters") - 2)
    df = df.withColumn("up", _sum(F.transform("codes", high))).withColumn("kind", kind)
    df = df.withColumn("runs", 1 + _sum(F.transform(pairs, lambda i: (high(F.get("codes", i)) != high(F.get("codes", i + 1))).cast("double"))))
    df = df.withColumn("changes", _sum(F.transform(pairs, lambda i: (F.get("kind", i) != F.get("kind", i + 1)).cast("double"))))
    df = df.withColumn("cross", _sum(F.transform(pairs, lambda i: (F.get("codes", i) - F.col("mean")) * (F.get("codes", i + 1) - F.col("mean")))))
    df = df.withColumn("spread", _sum(F.transform("codes", lambda v: (v - F.col("mean")) * (v - F.col("mean")))))
    # Chi-squared uniformity: (A / n) * sum of squares - n has mean A - 1 and variance about 2 (A - 1)(n - 1) / n.
    chi = (F.col("size") / n * F.col("squares") - n - (F.col("size") - 1)) / F.sqrt(2 * (F.col("size") - 1) * (n - 1) / n)
    up, down = F.col("up"), n - F.col("up")
    expected = 2 * up * down / n + 1
    deviation = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.25)))
    runs = F.abs(F.col("runs") - expected) / deviation
    serial = F.when(F.col("spread") > 0, F.abs(F.col("cross") / F.col("spread")) * F.sqrt(n)).otherwise(F.lit(99.0))
    one_sided = F.least(up, down) < 0.12 * n  # all letters in one half of the alphabet
    random = (F.abs(chi) < DEVIATION) & (runs < DEVIATION) & (serial < DEVIATION) & ~one_sided
    # Against text: few agreeing pairs, by which chi-squared is small (about Poisson), many changes of class (about binomial), less correlation (about normal).
    agree = (F.col("squares") - n) / 2
    hoped = n * (n - 1) / 2 * AGREE
    few = _tail((hoped - agree - 0.5) / F.sqrt(hoped * 1.5))
    many = _tail((F.col("changes") - 0.5 - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE)))
    low = F.when(F.col("spread") > 0, _tail((SERIAL - F.col("cross") / F.col("spread")) * F.sqrt(n / 1.5))).otherwise(F.lit(0.0))
    # Fisher: twice the sum is chi-squared with six degrees of freedom.
    df = df.withColumn("total", -(few + many + low))
    fisher = F.least(-F.col("total") + F.log(1 + F.col("total") + F.col("total") * F.col("total") / 2), F.lit(0.0))
    return df.withColumn("log_p", F.when(random, fisher).otherwise(F.lit(0.0))).withColumn("class", F.floor(F.log2(n)).cast("int"))


def _limits(tested: DataFrame) -> dict[int, float]:
    """Largest accepted log p of each length class by Benjamini-Hochberg on the histogram of all tested tokens."""
    bins = tested.groupBy("class", F.least(F.floor(-F.col("log_p") / BIN), F.lit(BINS)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()  # classes x bins, of fixed number
    out: dict[int, float] = {}
    for c in {r["class"] for r in bins}:
        own = sorted(((r["bin"], r["n"]) for r in bins if r["class"] == c), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if math.exp(-b * BIN) * total / seen <= FDR:
                out[c] = -b * BIN
    return out


def find_spans(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` (doc_id if none are given), base and added: arrays of (start, kind number, end) in order, for every row of ``docs``."""
    df = docs.select(*(kept or [F.col("doc_id").cast("long").alias("doc_id")]), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = df.columns[:-1]
    df = _spans(_spans(_spans(_spans(df, "assign", ASSIGN), "access", ACCESS), "hex", HEX), "candidate", CANDIDATE).drop("text")
    df = df.withColumn("assign", F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["token"], ASSIGN, 2)) >= ASSIGN_LEAST))
    tag = lambda k: F.transform(KINDS[k], lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    tagged = [tag(k) for k in range(3)]
    df = df.withColumn("base", F.sort_array(F.concat(*tagged)))
    free = lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    df = df.withColumn("candidate", F.filter("candidate", free)).select(*names, "base", "candidate")
    df = written(df.withColumn("_row", F.expr("uuid()")), "secret-spans")
    tokens = df.where(F.size("candidate") > 0).select("_row", F.explode("candidate").alias("c")).select("_row", "c.start", "c.end", "c.token")
    tested = written(_tested(tokens).select("_row", "start", "end", "log_p", "class"), "secret-tests")
    limits = _limits(tested)
    keep = F.lit(False)
    for c, limit in sorted(limits.items()):
        keep = keep | ((F.col("class") == c) & (F.col("log_p") <= limit))
    added = tested.where(keep).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end"))).alias("added"))
    empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    return df.join(added, "_row", "left").select(*names, "base", F.coalesce("added", empty).alias("added"))


def _digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans as text."""
    df = find_spans(docs)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _digest(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every base and added span of its texts replaced by ``mark`` and n_chars to match.

    Rows without a span keep their text, null included.
    """
    # The rows go through the scan as one column, so that their names meet none of its own.
    found = find_spans(docs, F.struct(*docs.columns).alias("_doc"))
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    parts = found.select("_doc", F.col("_doc.text").cast("string").alias("text"), spans.alias("_spans"))
    some = F.size("_spans") > 0
    # How far the spans before each reach: by groups of _PART spans, so that many spans cost no square of them.
    end = lambda a: F.array_max(F.transform(a, lambda s: s["end"]))
    groups = F.sequence(F.lit(0), F.expr(f"int((size(_spans) - 1) div {_PART})"))
    most = F.transform(groups, lambda g: end(F.slice("_spans", g * _PART + 1, F.lit(_PART))))
    before = lambda m: F.transform(m, lambda _, g: F.coalesce(F.array_max(F.slice(m, F.lit(1), g)), F.lit(0).cast("long")))
    ends = lambda b: F.transform("_spans", lambda s, i: F.greatest(F.get(b, (i / _PART).cast("int")), end(F.slice("_spans", i - i % _PART + 1, i % _PART))))
    parts = parts.withColumn("_ends", F.when(some, _let(most, lambda m: _let(before(m), ends))))
    # Texts are cut into chunks, so that what stands between two spans is found without reading the text from its start.
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def between(chunks: Column, a: Column, b: Column) -> Column:
        """The text from code point a to b."""
        first, last = (a / CHUNK).cast("int"), (b / CHUNK).cast("int")
        head = F.substring(F.get(chunks, first), (a % CHUNK + 1).cast("int"), F.least(b - a, F.lit(CHUNK)).cast("int"))
        middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.substring(F.get(chunks, last), F.lit(1), (b % CHUNK).cast("int"))
        return F.when(b <= a, F.lit("")).when(first == last, head).otherwise(F.concat(head, middle, F.coalesce(tail, F.lit(""))))

    # Spans that overlap leave nothing between, and one mark.
    def clean(chunks: Column, ends: Column) -> Column:
        piece = lambda s, i: F.concat(between(chunks, F.get(ends, i), s["start"]), F.when(s["start"] >= F.get(ends, i), F.lit(mark)).otherwise(F.lit("")))
        return F.concat(F.array_join(F.transform("_spans", piece), ""), between(chunks, end(F.col("_spans")), F.char_length("text").cast("long")))

    both = _let(chunks, lambda c: _let(F.col("_ends"), lambda e: clean(c, e)))
    out = parts.withColumn("_clean", F.when(some, both).otherwise(F.col("text")))
    given = lambda c: F.col("_doc")[c]
    size = lambda: F.when(some, F.char_length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(given("n_chars"))
    return out.select(*((F.col("_clean") if c == "text" else size() if c == "n_chars" else given(c)).alias(c) for c in docs.columns))
