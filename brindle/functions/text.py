"""String, encoding, bitwise, control, similarity and Unicode functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import BY_NAME, col, scalar, vectorized

BLANK = r"[\s\u0085   -     　]+"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


@scalar("concat")
def concat(*parts):
    """NULL counts as the empty text."""
    return F.concat(*(_text(p) for p in parts))


@scalar("concat_ws")
def concat_ws(sep, *parts):
    """NULL parts count as empty texts and are not skipped."""
    return F.concat(*[x for i, p in enumerate(parts) for x in ((sep, _text(p)) if i else (_text(p),))])


for _names, _f in {
    ("length",): lambda s: F.octet_length(s),
    ("char_length", "character_length"): lambda s: F.char_length(s),
    ("upper", "ucase"): lambda s: F.upper(s),
    ("lower", "lcase"): lambda s: F.lower(s),
    ("trim",): lambda s: F.regexp_replace(s, f"^{BLANK}|{BLANK}$", ""),
    ("ltrim",): lambda s: F.regexp_replace(s, f"^{BLANK}", ""),
    ("rtrim",): lambda s: F.regexp_replace(s, f"{BLANK}$", ""),
    ("left",): lambda s, n: F.when(n <= 0, "").otherwise(F.substring(s, F.lit(1), n)),
    ("right",): lambda s, n: F.when(n <= 0, "").otherwise(F.right(s, n)),
    ("replace",): lambda s, a, b: F.replace(s, a, b),
    ("repeat",): lambda s, n: F.repeat(s, n),
    ("reverse",): lambda s: F.reverse(s),
    ("position", "locate"): lambda a, s: F.call_function("locate", a, s),
    ("instr",): lambda s, a: F.call_function("locate", a, s),
    ("ascii", "ord"): lambda s: F.when(s == "", 0).otherwise(F.conv(F.substring(F.hex(s.cast("binary")), 1, 2), 16, 10).cast("int")),
    ("space",): lambda n: F.repeat(F.lit(" "), n),
    ("unicode",): lambda s: F.ascii(s),
    ("translate",): lambda s, a, b: F.call_function("translate", s, a, b),
    ("starts_with",): lambda s, a: F.startswith(s, a),
    ("ends_with",): lambda s, a: F.endswith(s, a),
    ("contains",): lambda s, a: F.contains(s, a),
    ("url_encode",): lambda s: F.url_encode(s),
    ("url_decode",): lambda s: F.url_decode(s),
    ("bit_count",): lambda n: F.bit_count(n),
    ("get_bit",): lambda n, i: F.getbit(n, i),
    ("bit_length",): lambda s: F.bit_length(s),
    ("to_base64", "base64"): lambda s: F.base64(s.cast("binary")),
    ("from_base64",): lambda s: F.unbase64(s),
    ("unhex",): lambda s: F.unhex(s),
    ("md5",): lambda s: F.md5(s.cast("binary")),
    ("sha1",): lambda s: F.sha1(s.cast("binary")),
    ("coalesce",): lambda *a: F.coalesce(*a),
    ("ifnull", "nvl"): lambda a, b: F.coalesce(a, b),
    ("nullif",): lambda a, b: F.when(a.cast("string") == b.cast("string"), None).otherwise(a),
    ("greatest",): lambda *a: F.greatest(*a),
    ("least",): lambda *a: F.least(*a),
    ("levenshtein",): lambda a, b: F.levenshtein(a, b),
}.items():
    scalar(*_names)(_f)


@scalar("substring", "substr", "mid")
def substring(s, start, length=None):
    """1-based; a start of 0 gives the empty text; negative starts count from the end."""
    part = F.substring(s, start, length) if length is not None else F.substring(s, start, F.char_length(s))
    return F.when(start == 0, "").otherwise(part)


def _pad(s, n, pad, left: bool):
    padded = F.call_function("lpad" if left else "rpad", s, n, pad)
    return F.when((F.char_length(pad) == 0) & (F.char_length(s) <= n), s).when(n <= 0, "").otherwise(padded)


scalar("lpad")(lambda s, n, pad: _pad(s, n, pad, True))
scalar("rpad")(lambda s, n, pad: _pad(s, n, pad, False))


@scalar("chr", "char")
def chr_(n):
    """The character of a code point: its UTF-32 bytes, decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")


@scalar("format", "printf")
def format_string(pattern, *args, spec: str | None = None):
    """printf formats; the pattern is a constant given as ``spec``, %v stands for %s."""
    return F.format_string((spec or "").replace("%v", "%s"), *([pattern, *args] if spec else args))


@scalar("set_bit")
def set_bit(n, pos, value):
    one = F.call_function("shiftleft", F.lit(1).cast("long"), pos.cast("int"))
    return F.when(value.cast("int") == 1, n.cast("long").bitwiseOR(one)).otherwise(n.cast("long").bitwiseAND(F.bitwise_not(one)))


@scalar("hex")
def hex_(x, text: bool = True):
    """Numbers (``text`` false) in capitals, texts in small letters."""
    return F.lower(F.hex(x.cast("binary"))) if text else F.hex(x)


@scalar("bin")
def bin_(n):
    """Binary digits; negative numbers have a sign."""
    return F.concat(F.when(n < 0, "-").otherwise(""), F.bin(F.abs(n)))


@scalar("sha2")
def sha2(s, bits):
    return F.when(bits == 512, F.sha2(s.cast("binary"), 512)).when(bits == 256, F.sha2(s.cast("binary"), 256)).otherwise(F.raise_error(F.lit("sha2 takes 256 or 512 bits")).cast("string"))


@scalar("encode")
def encode(s, kind):
    return F.when(kind == "hex", F.lower(F.hex(s.cast("binary")))).when(kind == "base64", F.base64(s.cast("binary")))


@scalar("decode")
def decode(s, kind):
    return F.when(kind == "hex", F.unhex(s)).when(kind == "base64", F.unbase64(s))


@vectorized
@F.pandas_udf(T.LongType())
def _fnv1a(s: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        h = 0xCBF29CE484222325
        for b in str(t).encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return s.map(one).astype("Int64")


scalar("hash")(lambda x: _fnv1a(x.cast("string")))


@scalar("if", "iif")
def if_(cond, a, b):
    return F.when(cond.cast("boolean"), a).otherwise(b)


# --- similarity -----------------------------------------------------------------------------------


@scalar("hamming")
def hamming(a, b):
    """Places that differ; texts of different length are an error."""
    n = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda differs: differs))
    same = F.char_length(a) == F.char_length(b)
    return F.when(same, n).when(~same, F.raise_error(F.lit("hamming: lengths differ")).cast("int"))


def _bigrams(s: Column) -> Column:
    n = F.char_length(s)
    return F.when(n < 2, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))


@scalar("jaccard")
def jaccard(a, b):
    """Jaccard index of the multisets of letter pairs; 1 for two empty texts."""
    x, y = _bigrams(a), _bigrams(b)
    count = lambda arr, g: F.size(F.filter(arr, lambda v: v == g))
    common = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, g: s + F.least(count(x, g), count(y, g)))
    both = F.size(x) + F.size(y) - common
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(common / both)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(mine, (c for c, u in zip(b, used) if u))) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    score, same = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return score + same * 0.1 * (1 - score)


def osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours (restricted)."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def _pairwise(f, kind: str):
    @vectorized
    @F.pandas_udf(T.LongType() if kind == "long" else T.DoubleType())
    def g(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="Int64" if kind == "long" else "float64")

    return g


scalar("damerau_levenshtein")(_pairwise(osa, "long"))
scalar("jaro_similarity")(_pairwise(jaro, "double"))
scalar("jaro_winkler_similarity")(_pairwise(jaro_winkler, "double"))


# --- Unicode --------------------------------------------------------------------------------------


def _mapped(f):
    @vectorized
    @F.pandas_udf(T.StringType())
    def g(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return g


def _bare(t: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


#: Marks that Unicode 15.1 has and older Java does not, and one that is no longer without width.
MARKS = (
    r"[\p{Mn}\x{898}-\x{89F}\x{8CA}-\x{8D2}\x{C3C}\x{ECE}\x{180F}\x{1AC1}-\x{1ACE}\x{1DFA}\x{10EFD}-\x{10EFF}\x{10F82}-\x{10F85}\x{11070}\x{11073}\x{11074}\x{110C2}\x{11241}\x{11F00}\x{11F01}"
    r"\x{11F36}-\x{11F3A}\x{11F40}\x{11F42}\x{13440}\x{13447}-\x{13455}\x{1CF00}-\x{1CF2D}\x{1CF30}-\x{1CF46}\x{1E08F}\x{1E2AE}\x{1E4EC}-\x{1E4EF}&&[^\x{1734}]]+"
)


def _in_jvm(s: Column, form: str) -> Column:
    """``s`` in a Unicode form by the ICU that Spark ships, so that no text goes to Python."""
    jvm = SparkContext._active_spark_context._jvm
    made, text, sql = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.java.lang.Class.forName("java.lang.String"), jvm.org.apache.spark.sql
    objects, string = sql.catalyst.expressions.objects, sql.types.ObjectType(text)
    seq = lambda *v: jvm.PythonUtils.toSeq(list(v))
    build = sql.catalyst.SerializerBuildHelper, sql.catalyst.DeserializerBuildHelper
    given = build[1].createDeserializerForString(made.expression(s.cast("string")._jc), True)
    compat = made.expression(F.lit("K" in form)._jc)
    icu = jvm.java.lang.Class.forName("com.ibm.icu.text.Normalizer")
    name = "decompose" if form.endswith("D") else "compose"
    mapped = objects.StaticInvoke(icu, string, name, seq(given, compat), seq(), True, True, True, jvm.scala.Option.empty())
    return Column(made.column(build[0].createSerializerForString(mapped)))


def _form(form: str):
    python = _mapped(lambda t: unicodedata.normalize(form, t))
    return lambda s: python(s) if BY_NAME.get() else _in_jvm(s, form)


FORMS = {f: _form(f) for f in ("NFC", "NFD", "NFKC", "NFKD")}
_bare_in_python = _mapped(_bare)


@scalar("strip_accents")
def strip_accents(s):
    return _bare_in_python(s) if BY_NAME.get() else _in_jvm(F.regexp_replace(_in_jvm(s, "NFD"), MARKS, ""), "NFC")


for _name, _f in FORMS.items():
    scalar(_name.lower())(_f)


@vectorized
@F.pandas_udf(T.StringType())
def _normalized(s: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize((f or "NFC").upper(), t) for t, f in zip(s, form)])


@scalar("unicode_normalize")
def unicode_normalize(s, form="NFC"):
    """NULL or the empty text as form is NFC."""
    if BY_NAME.get():
        return _normalized(s, col(form))
    given = F.upper(F.coalesce(F.nullif(col(form), F.lit("")), F.lit("NFC")))
    out = F.when(s.isNull(), F.lit(None).cast("string"))
    for f in FORMS:
        out = out.when(given == f, _in_jvm(s, f))
    return out.otherwise(F.raise_error(F.lit("invalid normalization form")).cast("string"))


@scalar("transliterate")
def transliterate(s, rule):
    bare = strip_accents(s)
    return F.when(F.lower(rule).contains("ascii"), bare).when(F.lower(rule).contains("upper"), F.upper(s)).when(F.lower(rule).contains("lower"), F.lower(s)).otherwise(s)


@scalar("icu_compare")
def icu_compare(a, b):
    x, y = F.collate(a, "UNICODE_CI"), F.collate(b, "UNICODE_CI")
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


scalar("icu_sort_key")(lambda s, locale=None: F.lower(F.hex(F.lower(strip_accents(s)).cast("binary"))))
scalar("collation")(lambda *_: F.lit("utf8mb4_unicode_ci"))
