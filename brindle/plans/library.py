"""Queries that apply the function library to whole tables, with the DuckDB SQL of what they give."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import call
from ..operators import fulltext, mutation, spatial_join, vector_search
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def _columns(source: str, key: list[str], columns: dict, digits: int = 6):
    """Rows of ``source``: the key and each (function, arguments...) under its name; doubles are rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        built = {n: call(c[0], *(F.expr(a[1:]) if isinstance(a, str) and a.startswith("=") else a for a in c[1:])) for n, c in columns.items()}
        out = df.select(*key, *[v.alias(n) for n, v in built.items()])
        return out.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

    return run


def _family(name: str, source: str, key: list[str], entries: dict[str, tuple[tuple, str]], digits: int = 6) -> None:
    """Register a query from name -> ((function, arguments), DuckDB expression)."""
    QUERIES[name] = _columns(source, key, {n: e[0] for n, e in entries.items()}, digits)
    ORACLE[name] = f"SELECT {', '.join(key)}, " + ", ".join(f"{e[1]} AS {n}" for n, e in entries.items()) + f" FROM {source}"


def _r(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits})"


_family("fn_string", "part", ["p_partkey"], {
    "f_concat": (("concat", "=p_name", "-", "=p_brand"), "p_name || '-' || p_brand"),
    "f_concat_ws": (("concat_ws", "/", "=p_name", "=nullif(p_brand, 'Brand#13')"), "p_name || '/' || coalesce(nullif(p_brand, 'Brand#13'), '')"),
    "f_length": (("length", "=p_name"), "strlen(p_name)::INT"),
    "f_char_length": (("char_length", "=p_name"), "length(p_name)::INT"),
    "f_upper": (("upper", "=p_name"), "upper(p_name)"),
    "f_lower": (("lcase", "=p_type"), "lower(p_type)"),
    "f_trim": (("trim", "=concat('  ', p_name, ' ')"), "trim(p_name)"),
    "f_ltrim": (("ltrim", "=concat('  ', p_name, ' ')"), "ltrim(p_name) || ' '"),
    "f_rtrim": (("rtrim", "=concat('  ', p_name, ' ')"), "'  ' || rtrim(p_name)"),
    "f_left": (("left", "=p_name", 4), "left(p_name, 4)"),
    "f_right": (("right", "=p_name", 3), "right(p_name, 3)"),
    "f_substring": (("substring", "=p_name", 2, 5), "substring(p_name, 2, 5)"),
    "f_substr0": (("substr", "=p_name", 0, 5), "''"),
    "f_replace": (("replace", "=p_name", "a", "4"), "replace(p_name, 'a', '4')"),
    "f_repeat": (("repeat", "=p_brand", 2), "repeat(p_brand, 2)"),
    "f_reverse": (("reverse", "=p_name"), "reverse(p_name)"),
    "f_lpad": (("lpad", "=p_brand", 12, "*"), "lpad(p_brand, 12, '*')"),
    "f_rpad": (("rpad", "=p_brand", 5, "*"), "rpad(p_brand, 5, '*')"),
    "f_position": (("position", "a", "=p_name"), "instr(p_name, 'a')::INT"),
    "f_instr": (("instr", "=p_name", "e"), "instr(p_name, 'e')::INT"),
    "f_ascii": (("ascii", "=p_name"), "ascii(p_name)"),
    "f_space": (("space", 3), "'   '"),
    "f_chr": (("chr", "=65 + p_size % 26"), "chr(65 + p_size % 26)"),
    "f_unicode": (("unicode", "=p_name"), "unicode(p_name)"),
    "f_translate": (("translate", "=p_name", "abc", "xyz"), "translate(p_name, 'abc', 'xyz')"),
    "f_starts": (("starts_with", "=p_type", "S"), "starts_with(p_type, 'S')"),
    "f_ends": (("ends_with", "=p_type", "L"), "ends_with(p_type, 'L')"),
    "f_contains": (("contains", "=p_type", "A"), "contains(p_type, 'A')"),
})
_family("fn_encoding", "customer", ["c_custkey"], {
    "f_hex": (("hex", "=c_name"), "lower(hex(c_name))"),
    "f_base64": (("to_base64", "=c_name"), "base64(c_name::BLOB)"),
    "f_bin": (("bin", "=c_custkey"), "bin(c_custkey)"),
    "f_md5": (("md5", "=c_name"), "md5(c_name)"),
    "f_sha1": (("sha1", "=c_name"), "sha1(c_name)"),
    "f_sha2": (("sha2", "=c_name", 256), "sha256(c_name)"),
    "f_encode": (("encode", "=c_name", "hex"), "lower(hex(c_name))"),
    "f_url": (("url_encode", "=c_mktsegment"), "url_encode(c_mktsegment)"),
    "f_bit_count": (("bit_count", "=c_custkey"), "bit_count(c_custkey)::INT"),
    "f_get_bit": (("get_bit", "=c_custkey", 1), "((c_custkey >> 1) & 1)::TINYINT"),
    "f_set_bit": (("set_bit", "=c_custkey", 3, 1), "c_custkey | 8"),
    "f_bit_length": (("bit_length", "=c_name"), "bit_length(c_name)::INT"),
})
_family("fn_math", "lineitem", ["l_orderkey", "l_linenumber"], {
    "f_abs": (("abs", "=l_quantity - 25"), "abs(l_quantity - 25)"),
    "f_ceil": (("ceil", "=l_discount * 37"), "ceil(l_discount * 37)"),
    "f_floor": (("floor", "=l_discount * 37"), "floor(l_discount * 37)"),
    "f_sqrt": (("sqrt", "=l_quantity"), _r("sqrt(l_quantity)")),
    "f_pow": (("pow", "=l_quantity", 2), _r("pow(l_quantity, 2)")),
    "f_exp": (("exp", "=l_discount"), _r("exp(l_discount)")),
    "f_ln": (("ln", "=l_quantity"), _r("ln(l_quantity)")),
    "f_log": (("log", 2, "=l_quantity"), _r("log2(l_quantity)")),
    "f_log10": (("log10", "=l_quantity"), _r("log10(l_quantity)")),
    "f_sin": (("sin", "=l_quantity"), _r("sin(l_quantity)")),
    "f_cos": (("cos", "=l_quantity"), _r("cos(l_quantity)")),
    "f_tan": (("tan", "=l_discount"), _r("tan(l_discount)")),
    "f_asin": (("asin", "=l_discount"), _r("asin(l_discount)")),
    "f_acos": (("acos", "=l_discount"), _r("acos(l_discount)")),
    "f_atan": (("atan", "=l_quantity"), _r("atan(l_quantity)")),
    "f_atan2": (("atan2", "=l_quantity", 3), _r("atan2(l_quantity, 3)")),
    "f_degrees": (("degrees", "=l_discount"), _r("degrees(l_discount)")),
    "f_radians": (("radians", "=l_quantity"), _r("radians(l_quantity)")),
    "f_pi": (("pi",), _r("pi()")),
    "f_sign": (("sign", "=l_quantity - 25"), "sign(l_quantity - 25)::DOUBLE"),
    "f_mod": (("mod", "=l_quantity", "=l_linenumber"), "fmod(l_quantity, l_linenumber)"),
    "f_cbrt": (("cbrt", "=l_quantity"), _r("cbrt(l_quantity)")),
    "f_sinh": (("sinh", "=l_discount"), _r("sinh(l_discount)")),
    "f_cosh": (("cosh", "=l_discount"), _r("cosh(l_discount)")),
    "f_tanh": (("tanh", "=l_discount"), _r("tanh(l_discount)")),
    "f_asinh": (("asinh", "=l_discount"), _r("asinh(l_discount)")),
    "f_acosh": (("acosh", "=l_quantity"), _r("acosh(l_quantity)")),
    "f_atanh": (("atanh", "=l_discount"), _r("atanh(l_discount)")),
    "f_factorial": (("factorial", "=l_linenumber"), "factorial(l_linenumber)::BIGINT"),
    "f_gcd": (("gcd", "=l_orderkey", 12), "gcd(l_orderkey, 12)"),
    "f_lcm": (("lcm", "=l_linenumber", 6), "lcm(l_linenumber::BIGINT, 6)"),
    "f_even": (("even", "=l_discount * 50"), "even(l_discount * 50)"),
    "f_is_nan": (("is_nan", "=l_quantity"), "isnan(l_quantity)"),
    "f_is_finite": (("is_finite", "=l_quantity"), "isfinite(l_quantity)"),
    "f_greatest": (("greatest", "=l_quantity", "=l_tax * 100"), _r("greatest(l_quantity, l_tax * 100)")),
    "f_least": (("least", "=l_quantity", "=l_tax * 100"), _r("least(l_quantity, l_tax * 100)")),
})
_family("fn_date", "orders", ["o_orderkey"], {
    "f_year": (("year", "=o_orderdate"), "year(o_orderdate)::INT"),
    "f_month": (("month", "=o_orderdate"), "month(o_orderdate)::INT"),
    "f_day": (("day", "=o_orderdate"), "day(o_orderdate)::INT"),
    "f_hour": (("hour", "=o_orderdate"), "hour(o_orderdate)::INT"),
    "f_date": (("date", "=o_orderdate"), "o_orderdate::DATE"),
    "f_time": (("time", "=o_orderdate"), "strftime(o_orderdate, '%H:%M:%S')"),
    "f_format": (("date_format", "=o_orderdate"), "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"),
    "f_dow": (("extract", "dow", "=o_orderdate"), "dayofweek(o_orderdate)::BIGINT"),
    "f_dayname": (("dayname", "=o_orderdate"), "dayname(o_orderdate)"),
    "f_monthname": (("monthname", "=o_orderdate"), "monthname(o_orderdate)"),
    "f_dayofweek": (("dayofweek", "=o_orderdate"), "(dayofweek(o_orderdate) + 1)::INT"),
    "f_dayofyear": (("dayofyear", "=o_orderdate"), "dayofyear(o_orderdate)::INT"),
    "f_week": (("week", "=o_orderdate"), "weekofyear(o_orderdate)::INT"),
    "f_quarter": (("quarter", "=o_orderdate"), "quarter(o_orderdate)::INT"),
    "f_last_day": (("last_day", "=o_orderdate"), "last_day(o_orderdate)"),
    "f_unix": (("unix_timestamp", "=o_orderdate"), "epoch(o_orderdate)::BIGINT"),
    "f_trunc": (("date_trunc", "week", "=o_orderdate"), "date_trunc('week', o_orderdate)::TIMESTAMP"),
    "f_make_date": (("make_date", "=year(o_orderdate)", 13, 1), "make_date(year(o_orderdate) + 1, 1, 1)"),
    "f_century": (("century", "=o_orderdate"), "century(o_orderdate)::INT"),
    "f_decade": (("decade", "=o_orderdate"), "decade(o_orderdate)::INT"),
    "f_millennium": (("millennium", "=o_orderdate"), "millennium(o_orderdate)::INT"),
    "f_era": (("era", "=o_orderdate"), "'AD'"),
    "f_isodow": (("isodow", "=o_orderdate"), "isodow(o_orderdate)::INT"),
    "f_isoyear": (("isoyear", "=o_orderdate"), "isoyear(o_orderdate)::INT"),
    "f_julian": (("julian_day", "=o_orderdate"), _r("epoch(o_orderdate) / 86400 + 2440587.5")),
    "f_year_week": (("year_week", "=o_orderdate"), "yearweek(o_orderdate)::INT"),
    "f_add": (("date_add", "=o_orderdate", 40), "o_orderdate + INTERVAL 40 DAY"),
    "f_sub": (("date_sub", "=o_orderdate", 3), "o_orderdate - INTERVAL 3 DAY"),
    "f_datediff": (("datediff", "=o_orderdate", "1995-01-01 00:00:00"), "trunc((epoch(o_orderdate) - epoch(TIMESTAMP '1995-01-01')) / 86400)::BIGINT"),
})
_family("fn_time_bucket", "events", ["event_id"], {
    "f_bucket": (("time_bucket", 3600, "=ts"), "to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP"),
    "f_minute": (("minute", "=ts"), "minute(ts)::INT"),
    "f_second": (("second", "=ts"), "second(ts)::INT"),
    "f_epoch": (("epoch", "=ts"), "floor(epoch(ts))::BIGINT"),
})
_family("fn_json", "events", ["event_id"], {
    "f_extract": (("json_extract", "=props", "$.k"), "json_extract(props, '$.k')::VARCHAR"),
    "f_valid": (("json_valid", "=props"), "json_valid(props)::INT"),
    "f_type": (("json_type", "=props"), "json_type(props)"),
    "f_length": (("json_length", "=props"), "len(json_keys(props))::INT"),
    "f_keys": (("json_keys", "=props"), "to_json(list_sort(json_keys(props)))::VARCHAR"),
    "f_set": (("json_set", "=props", "$.z", "1"), "json_merge_patch(props, '{\"z\":1}')::VARCHAR"),
    "f_patch": (("json_merge_patch", "=props", '{"z":1}'), "json_merge_patch(props, '{\"z\":1}')::VARCHAR"),
    "f_remove": (("json_remove", "=props", "$.k"), "json_merge_patch(props, '{\"k\":null}')::VARCHAR"),
    "f_contains_path": (("json_contains_path", "=props", "one", "$.k"), "json_exists(props, '$.k')::INT"),
    "f_array": (("json_array", "=event_id", "=event_type"), "json_array(event_id, event_type)::VARCHAR"),
    "f_object": (("json_object", "id", "=event_id"), "json_object('id', event_id)::VARCHAR"),
    "f_quote": (("json_quote", "=event_type"), "to_json(event_type)::VARCHAR"),
    "f_depth": (("json_depth", "=props"), "2"),
})
_family("fn_control", "lineitem", ["l_orderkey", "l_linenumber"], {
    "f_coalesce": (("coalesce", "=nullif(l_returnflag, 'A')", "x"), "coalesce(nullif(l_returnflag, 'A'), 'x')"),
    "f_nullif": (("nullif", "=l_returnflag", "A"), "nullif(l_returnflag, 'A')"),
    "f_ifnull": (("ifnull", "=nullif(l_returnflag, 'R')", "y"), "ifnull(nullif(l_returnflag, 'R'), 'y')"),
    "f_if": (("if", "=l_quantity > 10", "big", "small"), "if(l_quantity > 10, 'big', 'small')"),
    "f_typeof": (("typeof", "=l_quantity"), "'DOUBLE'"),
})
_family("fn_similarity", "supplier", ["s_suppkey"], {
    "f_levenshtein": (("levenshtein", "=s_name", "Supplier#000000001"), "levenshtein(s_name, 'Supplier#000000001')::INT"),
    "f_damerau": (("damerau_levenshtein", "=s_name", "Supplier#000000001"), "damerau_levenshtein(s_name, 'Supplier#000000001')"),
    "f_jaro": (("jaro_similarity", "=s_name", "Supplier#000000001"), _r("jaro_similarity(s_name, 'Supplier#000000001')")),
    "f_jaro_winkler": (("jaro_winkler_similarity", "=s_name", "Supplier#000000001"), _r("jaro_winkler_similarity(s_name, 'Supplier#000000001')")),
})
_family("fn_finance", "part", ["p_partkey"], {
    "f_fv": (("fv", 0.05, 10, "=-p_retailprice"), _r("p_retailprice * (pow(1.05, 10) - 1) / 0.05", 4)),
    "f_pv": (("pv", 0.05, 10, "=-p_retailprice"), _r("p_retailprice * (1 - pow(1.05, -10)) / 0.05", 4)),
    "f_pmt": (("pmt", 0.05, 10, "=p_retailprice"), _r("-p_retailprice * 0.05 / (1 - pow(1.05, -10))", 4)),
    "f_npv": (("npv", 0.1, "=p_retailprice", 100), _r("p_retailprice / 1.1 + 100 / 1.21", 4)),
    "f_sln": (("sln", "=p_retailprice", 10, 5), _r("(p_retailprice - 10) / 5", 4)),
    "f_syd": (("syd", "=p_retailprice", 10, 5, 2), _r("(p_retailprice - 10) * 4 / 15", 4)),
    "f_compound": (("compound_interest", "=p_retailprice", 0.04, 4, 2), _r("p_retailprice * pow(1.01, 8)", 4)),
    "f_simple": (("simple_interest", "=p_retailprice", 0.04, 2), _r("p_retailprice * 0.08", 4)),
    "f_cagr": (("cagr", 100, "=p_retailprice", 3), _r("pow(p_retailprice / 100, 1.0 / 3) - 1", 4)),
    "f_roi": (("roi", "=p_retailprice", 100), _r("p_retailprice - 100", 4)),
    "f_bond": (("bond_price", "=p_retailprice", 0.05, 0.04, 2, 1), _r("p_retailprice * 0.05 / 1.04 + p_retailprice * 1.05 / (1.04 * 1.04)", 4)),
}, 4)
_family("fn_unicode", "documents", ["doc_id"], {
    "f_nfc": (("nfc", "=text"), "nfc_normalize(text)"),
    "f_strip": (("strip_accents", "=text"), "strip_accents(text)"),
    "f_length": (("length", "=text"), "strlen(text)::INT"),
    "f_chars": (("char_length", "=text"), "length(text)::INT"),
})


@query("fn_rounding", """SELECT l_orderkey, l_linenumber, (((l_extendedprice * 100)::BIGINT + 50) // 100)::DOUBLE AS f_round, ((l_extendedprice * 100)::BIGINT // 10) / 10.0 AS f_truncate FROM lineitem""")
def rounding(spark, sf_dir):
    """Prices are whole cents, so the SQL works in these."""
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", call("round", p).alias("f_round"), call("truncate", p, 1).alias("f_truncate"))


@query("aggregates_basic", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS s, round(avg(l_tax), 8) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi,
  round(stddev_pop(l_quantity), 6) AS sd, round(var_pop(l_quantity), 4) AS var, round(stddev_samp(l_quantity), 6) AS sds, round(var_samp(l_quantity), 4) AS vars,
  count_if(l_quantity > 25)::BIGINT AS big, bool_and(l_quantity > 0) AS every_pos, bool_or(l_quantity > 49) AS some_big,
  round(median(l_quantity), 4) AS med, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, quantile_disc(l_quantity, 0.9) AS p90,
  round(corr(l_quantity, l_extendedprice), 6) AS corr, round(covar_pop(l_quantity, l_extendedprice), 2) AS cov, round(covar_samp(l_quantity, l_extendedprice), 2) AS covs,
  count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag""")
def aggregates_basic(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    r = lambda c, d: F.round(c, d)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        call("count").alias("n"), r(call("sum", q), 4).alias("s"), r(call("avg", F.col("l_tax")), 8).alias("a"), call("min", F.col("l_shipdate")).alias("lo"), call("max", F.col("l_shipdate")).alias("hi"),
        r(call("stddev", q), 6).alias("sd"), r(call("variance", q), 4).alias("var"), r(call("stddev_samp", q), 6).alias("sds"), r(call("var_samp", q), 4).alias("vars"),
        call("count_if", q > 25).alias("big"), call("every", q > 0).alias("every_pos"), call("bool_or", q > 49).alias("some_big"),
        r(call("median", q), 4).alias("med"), r(call("percentile_cont", 0.25, p), 4).alias("p25"), call("percentile_disc", 0.9, q).alias("p90"),
        r(call("corr", q, p), 6).alias("corr"), r(call("covar_pop", q, p), 2).alias("cov"), r(call("covar_samp", q, p), 2).alias("covs"), call("approx_count_distinct", F.col("l_partkey")).alias("parts"),
    )


@query("aggregates_text", """SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, mode(n_regionkey)::VARCHAR AS top, round(product(n_nationkey + 1.0), 2) AS prod FROM nation GROUP BY n_regionkey""")
def aggregates_text(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(call("group_concat", F.col("n_name")).alias("names"), call("mode", F.col("n_regionkey")).alias("top"), F.round(call("product", F.col("n_nationkey") + 1.0), 2).alias("prod"))


@query("aggregates_moments", """WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mu FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round((sum(pow(l_quantity - mu, 3)) / max(n)) / pow(sum(pow(l_quantity - mu, 2)) / max(n), 1.5), 6) AS skew,
  round((sum(pow(l_quantity - mu, 4)) / max(n)) / pow(sum(pow(l_quantity - mu, 2)) / max(n), 2) - 3, 6) AS kurt FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY 1""")
def aggregates_moments(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(call("skewness", q), 6).alias("skew"), F.round(call("kurtosis", q), 6).alias("kurt"))


@query("aggregates_entropy", "WITH c AS (SELECT l_returnflag, l_linenumber, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY 1")
def aggregates_entropy(spark, sf_dir):
    from ..functions.aggregates import entropy_by

    return entropy_by(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber").select("l_returnflag", F.round("entropy", 6).alias("entropy"))


@query("aggregates_list", "SELECT conv_id, to_json(list(role ORDER BY turn))::VARCHAR AS roles FROM conversations GROUP BY conv_id")
def aggregates_list(spark, sf_dir):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(ordered).alias("roles"))


# --- full text ------------------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 100)"


@query("ft_tokens", f"SELECT doc_id AS doc, len({_WORDS})::INT AS n, len(list_distinct({_WORDS}))::INT AS kinds FROM documents")
def ft_tokens(spark, sf_dir):
    w = fulltext.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds"))


@query("ft_postings", f"WITH w AS (SELECT doc_id AS doc, unnest({_WORDS}) AS term FROM documents) SELECT term, count(DISTINCT doc) AS df, count(*) AS cf FROM w GROUP BY term")
def ft_postings(spark, sf_dir):
    return fulltext.postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_BM25 = f"""WITH d AS (SELECT doc_id AS doc, {_WORDS} AS w FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM d),
t AS (SELECT unnest(['stupid', 'worthless', 'license']) AS term), h AS (SELECT doc, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS l FROM d, t), f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM h GROUP BY term),
b AS (SELECT doc, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM h JOIN f USING (term), s GROUP BY doc)"""


def _scored(name: str, terms: list[str]) -> str:
    """Common table expressions ending in ``name`` (doc, score)."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""{name}h AS (SELECT doc, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS l FROM d, (SELECT unnest([{listed}]) AS term)), {name}f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM {name}h GROUP BY term),
{name}b AS (SELECT doc, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score FROM {name}h JOIN {name}f USING (term), s GROUP BY doc), {name} AS (SELECT doc, score FROM {name}b WHERE score > 0)"""


_TWO = f"WITH d AS (SELECT doc_id AS doc, {_WORDS} AS w FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM d), "
_TOPS = _TWO + _scored("x0", ["stupid", "trash"]) + ", " + _scored("y0", ["license"]) + ", x AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS r FROM x0 QUALIFY r <= 50), y AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS r FROM y0 QUALIFY r <= 50) "


@query("ft_bm25", _BM25 + " SELECT doc, round(score, 6) AS score FROM b WHERE score > 0")
def ft_bm25(spark, sf_dir):
    found = fulltext.bm25(table(spark, sf_dir, "documents"), ["stupid", "worthless", "license"])
    return found.select("doc", F.round("score", 6).alias("score"))


@query("ft_top10", _BM25 + " SELECT doc, round(score, 6) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, doc LIMIT 10")
def ft_top10(spark, sf_dir):
    found = fulltext.bm25(table(spark, sf_dir, "documents"), ["stupid", "worthless", "license"])
    return fulltext.top(found, 10).select("doc", F.round("score", 6).alias("score"))


@query("ft_phrase", "SELECT doc_id AS doc FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])apache[^\\p{L}\\p{N}]+license([^\\p{L}\\p{N}]|$)')")
def ft_phrase(spark, sf_dir):
    return fulltext.phrase(table(spark, sf_dir, "documents"), ["apache", "license"])


@query("ft_boolean", f"SELECT doc_id AS doc, (1 + list_contains({_WORDS}, 'stupid')::INT + list_contains({_WORDS}, 'trash')::INT)::DOUBLE AS score FROM documents WHERE list_contains({_WORDS}, 'the') AND NOT list_contains({_WORDS}, 'license') AND (list_contains({_WORDS}, 'stupid') OR list_contains({_WORDS}, 'trash'))")
def ft_boolean(spark, sf_dir):
    return fulltext.boolean(table(spark, sf_dir, "documents"), must=["the"], must_not=["license"], should=["stupid", "trash"])


@query("ft_fuzzy", f"SELECT doc_id AS doc, round(list_max(list_transform(list_filter({_WORDS}, lambda w: levenshtein(w, 'licensed') <= 2), lambda w: 1 - levenshtein(w, 'licensed') / greatest(length(w), 8))), 6) AS score FROM documents WHERE len(list_filter({_WORDS}, lambda w: levenshtein(w, 'licensed') <= 2)) > 0")
def ft_fuzzy(spark, sf_dir):
    return fulltext.fuzzy(table(spark, sf_dir, "documents"), "licensed", 2).select("doc", F.round("score", 6).alias("score"))


@query("ft_wildcard", "SELECT doc_id AS doc FROM documents WHERE source LIKE 'src1_'")
def ft_wildcard(spark, sf_dir):
    return fulltext.wildcard(table(spark, sf_dir, "documents"), "src1?", "source")


@query("ft_highlight", "SELECT doc_id, CASE WHEN source IN ('src1', 'src12') THEN '<em>' || source || '</em>' ELSE source END AS h FROM documents")
def ft_highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fulltext.highlight(F.col("source"), ["src1", "src12"]).alias("h"))


@query("ft_hybrid_rrf", _TOPS + "SELECT doc, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY doc")
def ft_hybrid_rrf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lists = [fulltext.top(fulltext.bm25(docs, q), 50) for q in (["stupid", "trash"], ["license"])]
    return fulltext.fuse_rrf(lists).select("doc", F.round("score", 8).alias("score"))


@query("ft_hybrid_weighted", _TOPS + "SELECT doc, round(sum(score), 8) AS score FROM (SELECT doc, 0.7 * score / (SELECT max(score) FROM x) AS score FROM x UNION ALL SELECT doc, 0.3 * score / (SELECT max(score) FROM y) AS score FROM y) GROUP BY doc")
def ft_hybrid_weighted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lists = [(fulltext.top(fulltext.bm25(docs, q), 50), w) for q, w in ((["stupid", "trash"], 0.7), (["license"], 0.3))]
    return fulltext.fuse_weighted(lists).select("doc", F.round("score", 8).alias("score"))


@query("ft_disjunction_max", _TWO + _scored("x", ["stupid"]) + ", " + _scored("y", ["trash"]) + " SELECT doc, round(max(score) + 0.1 * (CASE WHEN count(*) > 1 THEN min(score) ELSE 0 END), 8) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY doc")
def ft_disjunction_max(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return fulltext.disjunction_max([fulltext.bm25(docs, ["stupid"]), fulltext.bm25(docs, ["trash"])], 0.1).select("doc", F.round("score", 8).alias("score"))


# --- vectors --------------------------------------------------------------------------------------

_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _first(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


for _metric, _expr in (("cosine", "list_cosine_distance"), ("l2", "list_distance"), ("ip", "list_negative_inner_product")):

    @query(f"vec_flat_{_metric}", f"SELECT vec_id AS id, round({_expr}(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 5) AS distance FROM embeddings ORDER BY {_expr}(embedding::DOUBLE[], {_Q0}::DOUBLE[]), vec_id LIMIT 10")
    def vec_flat(spark, sf_dir, metric=_metric):
        found = vector_search.flat_search(table(spark, sf_dir, "embeddings"), _first(spark, sf_dir), 10, metric)
        return found.select("id", F.round("distance", 5).alias("distance"))


@query("vec_functions", f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 5) AS c, round(list_distance(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 5) AS l, round(list_inner_product(embedding::DOUBLE[], {_Q0}::DOUBLE[]), 5) AS i FROM embeddings")
def vec_functions(spark, sf_dir):
    q = F.array(*(F.lit(float(v)) for v in _first(spark, sf_dir)))
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(call(f, e, q), 5).alias(n) for f, n in (("vec_cosine_distance", "c"), ("vec_l2_distance", "l"), ("vec_inner_product", "i"))])


@query("vec_knn_exact", """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT query, vec_id AS id, row_number() OVER (PARTITION BY query ORDER BY list_distance(v, embedding::DOUBLE[]), vec_id) AS rank FROM q, embeddings) SELECT query, id, rank::INT AS rank FROM r WHERE rank <= 5""")
def vec_knn_exact(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector_search.exact_knn(e, e.where("vec_id % 20 = 0"), 5, "l2").select("query", "id", "rank")


for _code in ("flat", "sq8", "pq", "bits"):

    @query(f"vec_ivf_{_code}_recall")
    def vec_ivf(spark, sf_dir, code=_code):
        e = table(spark, sf_dir, "embeddings")
        q = e.where("vec_id % 20 = 0")
        shared = spark.conf.get("spark.checkpoint.dir", None)
        path = f"{shared}/ivf-{code}-{uuid.uuid4().hex}" if shared else None
        found = vector_search.Ivf(e, 32, code, path=path).search(q, 10, probes=24, keep=12)
        return vector_search.recall(found, vector_search.exact_knn(e, q, 10, "l2"))


# --- spatial --------------------------------------------------------------------------------------


@query("spatial_functions", "SELECT s_suppkey, round(s_acctbal, 6) AS x, 1.0 * s_nationkey AS y, round(sqrt(s_acctbal * s_acctbal + s_nationkey * s_nationkey), 6) AS d, 4.0 AS a, 8.0 AS p, true AS inside FROM supplier")
def spatial_functions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    p = call("st_point", F.col("s_acctbal"), F.col("s_nationkey"))
    b = call("st_makeenvelope", F.floor("s_acctbal") - 0, F.col("s_nationkey") - 1, F.floor("s_acctbal") + 2, F.col("s_nationkey") + 1)
    cols = {"x": call("st_x", p), "y": call("st_y", p), "d": call("st_distance", p, "POINT(0 0)"), "a": call("st_area", b), "p": call("st_perimeter", b)}
    return s.select("s_suppkey", *[F.round(v, 6).alias(n) for n, v in cols.items()], call("st_contains", b, p).alias("inside"))


@query("spatial_grid_join", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON c.c_acctbal BETWEEN s.s_acctbal AND s.s_acctbal + 100 AND c.c_nationkey BETWEEN s.s_nationkey AND s.s_nationkey + 2")
def spatial_grid_join(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    s = table(spark, sf_dir, "supplier")
    boxes = s.select("s_suppkey", F.col("s_acctbal").alias("x0"), (F.col("s_acctbal") + 100).alias("x1"), F.col("s_nationkey").cast("double").alias("y0"), (F.col("s_nationkey") + 2.0).alias("y1"))
    return spatial_join.points_in_boxes(points, boxes, 50.0).select("c_custkey", "s_suppkey")


# --- mutations and views --------------------------------------------------------------------------


@query("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update(spark, sf_dir):
    return mutation.update(table(spark, sf_dir, "customer"), {"c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("dml_delete", "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING')")
def dml_delete(spark, sf_dir):
    return mutation.delete(table(spark, sf_dir, "customer"), F.col("c_mktsegment") == "BUILDING").select("c_custkey")


@query("dml_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def dml_insert(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return mutation.insert(table(spark, sf_dir, "region"), rows)


@query("dml_upsert", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name FROM nation")
def dml_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = n.where("n_regionkey = 1").withColumn("n_name", F.lit("X"))
    return mutation.upsert(n, rows, ["n_nationkey"]).select("n_nationkey", "n_name")


@query("generated_columns", "SELECT l_orderkey, l_linenumber, l_extendedprice * l_quantity AS subtotal, l_extendedprice * l_quantity * 1.1 AS total FROM lineitem")
def generated_columns(spark, sf_dir):
    df = mutation.generated(table(spark, sf_dir, "lineitem"), {"total_": "subtotal_ * 1.1", "subtotal_": "l_extendedprice * l_quantity"})
    return df.select("l_orderkey", "l_linenumber", F.col("subtotal_").alias("subtotal"), F.col("total_").alias("total"))


@query("filter_records", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND (p_type LIKE 'S%' OR p_brand IN ('Brand#11', 'Brand#22')) AND NOT (p_retailprice > 1500)")
def filter_records(spark, sf_dir):
    record = {"logic": "AND", "filters": [
        {"field": "p_size", "operator": "BETWEEN", "value": (5, 15)},
        {"logic": "OR", "filters": [{"field": "p_type", "operator": "LIKE", "value": "S%"}, {"field": "p_brand", "operator": "IN", "value": ["Brand#11", "Brand#22"]}]},
        {"logic": "NOT", "filters": [{"field": "p_retailprice", "operator": ">", "value": 1500}]},
    ]}
    return mutation.select(table(spark, sf_dir, "part"), record, ["p_partkey"])
