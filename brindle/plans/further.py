"""Further queries over whole tables: more of the function library and of the full-text queries, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import call
from ..operators import fulltext
from .library import _WORDS, _scored, _TWO
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def _family(name: str, source: str, key: list[str], entries: dict[str, tuple[Callable[[], Column], str]], digits: int = 6) -> None:
    """Register a query from name -> (function that gives the column, DuckDB expression); doubles are rounded on both sides."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = table(spark, sf_dir, source).select(*key, *[f().alias(n) for n, (f, _) in entries.items()])
        return out.select(*[F.round(n, digits).alias(n) if t == "double" and n not in key else c(n) for n, t in out.dtypes])

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {', '.join(key)}, " + ", ".join(f"{e} AS {n}" for n, (_, e) in entries.items()) + f" FROM {source}"


def _r(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits})"


_PAIRS = lambda s: f"list_transform(range(1, length({s})), lambda i: substring({s}, i, 2))"
_COMMON = f"list_sum(list_transform(list_distinct({_PAIRS('p_name')}), lambda g: least(len(list_filter({_PAIRS('p_name')}, lambda v: v = g)), len(list_filter({_PAIRS('p_type')}, lambda v: v = g)))))"

_family("fn_text_more", "part", ["p_partkey"], {
    "f_printf": (lambda: call("printf", c("p_name"), c("p_size"), spec="%s:%05d"), "printf('%s:%05d', p_name, p_size)"),
    "f_format": (lambda: call("format", c("p_brand"), spec="<%v>"), "'<' || p_brand || '>'"),
    "f_url_decode": (lambda: call("url_decode", call("url_encode", c("p_type"))), "url_decode(url_encode(p_type))"),
    "f_unhex": (lambda: call("unhex", call("hex", c("p_name"))).cast("string"), "p_name"),
    "f_from_base64": (lambda: call("from_base64", call("to_base64", c("p_name"))).cast("string"), "p_name"),
    "f_decode": (lambda: call("decode", call("encode", c("p_brand"), "base64"), "base64").cast("string"), "p_brand"),
    "f_hamming": (lambda: call("hamming", c("p_name"), F.reverse("p_name")), "hamming(p_name, reverse(p_name))"),
    "f_jaccard": (lambda: call("jaccard", c("p_name"), c("p_type")), _r(f"{_COMMON} / (length(p_name) + length(p_type) - 2 - {_COMMON})")),
    "f_mid": (lambda: call("mid", c("p_name"), 3, 2), "substring(p_name, 3, 2)"),
    "f_ord": (lambda: call("ord", c("p_name")), "ascii(p_name)"),
    "f_space": (lambda: F.concat(F.lit("|"), call("space", c("p_size")), F.lit("|")), "'|' || repeat(' ', p_size) || '|'"),
    "f_base64_encode": (lambda: call("base64_encode", c("p_name")), "base64(p_name::BLOB)"),
    "f_base64_decode": (lambda: call("base64_decode", call("base64_encode", c("p_name"))), "p_name"),
    "f_hex_encode": (lambda: call("hex_encode", c("p_name")), "lower(hex(p_name))"),
    "f_hex_decode": (lambda: call("hex_decode", F.lit("414243")), "unhex('414243')::VARCHAR"),
    "f_sha256": (lambda: call("sha256", c("p_name")), "sha256(p_name)"),
    "f_jaro_winkler": (lambda: call("jaro_winkler", c("p_name"), c("p_type")), _r("jaro_winkler_similarity(p_name, p_type)")),
})
_family("fn_bits", "customer", ["c_custkey"], {
    "f_and": (lambda: call("bitwise_and", c("c_custkey"), 12), "c_custkey & 12"),
    "f_or": (lambda: call("bitwise_or", c("c_custkey"), 5), "c_custkey | 5"),
    "f_xor": (lambda: call("bitwise_xor", c("c_custkey"), 255), "xor(c_custkey, 255::BIGINT)"),
    "f_not": (lambda: call("bitwise_not", c("c_custkey")), "~c_custkey"),
    "f_lshift": (lambda: call("lshift", c("c_custkey"), 3), "c_custkey << 3"),
    "f_rshift": (lambda: call("rshift", c("c_custkey"), 2), "c_custkey >> 2"),
})
_family("fn_math_more", "lineitem", ["l_orderkey", "l_linenumber"], {
    "f_log2": (lambda: call("log2", c("l_quantity")), _r("log2(l_quantity)")),
    "f_cot": (lambda: call("cot", c("l_quantity")), _r("cot(l_quantity)")),
    "f_infinite": (lambda: call("is_infinite", c("l_quantity")), "isinf(l_quantity)"),
    "f_banker": (lambda: call("round_banker", c("l_quantity") / 2, 0), "round_even(l_quantity / 2, 0)"),
    "f_currency": (lambda: call("round_currency", c("l_quantity") / 8), "(floor(l_quantity / 8 * 100 + 0.5) / 100)"),
    "f_round_truncate": (lambda: call("round_truncate", c("l_quantity") / 8, 2), "(trunc(l_quantity / 8 * 100) / 100)"),
    "f_ceiling": (lambda: call("ceiling", c("l_quantity") / 3), "ceil(l_quantity / 3)"),
    "f_power": (lambda: call("power", c("l_tax"), 2), _r("power(l_tax, 2)")),
})

_P, _Y = "p_retailprice", "(p_size / 1000.0)"
_PMT = f"(-{_P} * 0.05 / (1 - pow(1.05, -10)))"
_IPMT = f"(-({_P} * pow(1.05, 2) + {_PMT} * (pow(1.05, 2) - 1) / 0.05) * 0.05)"
_DURATION = f"((0.05 / (1 + {_Y}) + 2 * 1.05 / pow(1 + {_Y}, 2)) / (0.05 / (1 + {_Y}) + 1.05 / pow(1 + {_Y}, 2)))"
_bond = lambda name: call(name, c("p_retailprice"), 0.05, c("p_size") / 1000, F.lit(2), F.lit(1))
_family("fn_finance_more", "part", ["p_partkey"], {
    "f_ipmt": (lambda: call("ipmt", 0.05, 3, 10, c(_P)), _r(_IPMT, 4)),
    "f_ppmt": (lambda: call("ppmt", 0.05, 3, 10, c(_P)), _r(f"{_PMT} - {_IPMT}", 4)),
    "f_nper": (lambda: call("nper", 0.05, -200, c(_P)), _r(f"ln(200 / (200 - {_P} * 0.05)) / ln(1.05)", 4)),
    "f_ddb": (lambda: call("ddb", c(_P), 100, 5, F.lit(2)), _r(f"{_P} * 0.6 * 0.4", 4)),
    "f_rate": (lambda: call("pv", call("rate", 10, -c(_P) / 8, c(_P)), 10, -c(_P) / 8), _r(_P, 4)),
    "f_irr": (lambda: call("irr", F.concat(F.lit("[-1000,"), c(_P).cast("string"), F.lit("]"))), _r(f"{_P} / 1000 - 1", 4)),
    "f_xirr": (lambda: call("xirr", F.concat(F.lit("[-1000,"), c(_P).cast("string"), F.lit("]")), '["2023-01-01","2024-01-01"]'), _r(f"{_P} / 1000 - 1", 4)),
    "f_bond_yield": (lambda: call("bond_yield", _bond("bond_price"), c(_P), 0.05, 2, 1), _r(_Y, 4)),
    "f_duration": (lambda: _bond("bond_duration"), _r(_DURATION, 4)),
    "f_mduration": (lambda: _bond("bond_mduration"), _r(f"{_DURATION} / (1 + {_Y})", 4)),
    "f_convexity": (lambda: _bond("bond_convexity"), _r(f"(2 * 0.05 / (1 + {_Y}) + 6 * 1.05 / pow(1 + {_Y}, 2)) / ((0.05 / (1 + {_Y}) + 1.05 / pow(1 + {_Y}, 2)) * pow(1 + {_Y}, 2))", 4)),
}, 4)
_MONTHS = "((year(o_orderdate) - 1990) * 12 + month(o_orderdate) - 1)"
_family("fn_date_more", "orders", ["o_orderkey"], {
    "f_from_unixtime": (lambda: call("from_unixtime", call("unix_timestamp", c("o_orderdate"))).cast("timestamp_ntz"), "date_trunc('second', o_orderdate)::TIMESTAMP"),
    "f_to_timestamp": (lambda: call("to_timestamp", c("o_orderkey")).cast("timestamp_ntz"), "epoch_ms(o_orderkey * 1000)"),
    "f_make_time": (lambda: call("make_time", F.month("o_orderdate"), F.lit(5), F.lit(7)), "printf('%02d:05:07', month(o_orderdate))"),
    "f_make_timestamp": (lambda: call("make_timestamp", F.year("o_orderdate"), F.lit(2), F.lit(3), F.lit(4), F.lit(5), F.lit(6)).cast("timestamp_ntz"), "make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6)"),
    "f_age": (lambda: call("age", F.date_trunc("month", c("o_orderdate")), "1990-01-01"), f"({_MONTHS} // 12) || ' years ' || ({_MONTHS} % 12) || ' months 0 days'"),
    "f_date_part": (lambda: call("date_part", "doy", c("o_orderdate")), "dayofyear(o_orderdate)::BIGINT"),
    "f_weekday": (lambda: call("weekday", c("o_orderdate")), "(isodow(o_orderdate) - 1)::INT"),
    "f_str_to_date": (lambda: call("str_to_date", F.date_format("o_orderdate", "dd/MM/yyyy"), "%d/%m/%Y").cast("timestamp_ntz"), "date_trunc('day', o_orderdate)::TIMESTAMP"),
    "f_timestampdiff": (lambda: call("timestampdiff", "month", F.lit("1990-01-01"), F.date_trunc("month", c("o_orderdate"))), f"{_MONTHS}::BIGINT"),
    "f_adddate": (lambda: call("adddate", c("o_orderdate"), 2, by="week").cast("timestamp_ntz"), "(o_orderdate + INTERVAL 14 DAY)::TIMESTAMP"),
    "f_subdate": (lambda: call("subdate", F.date_trunc("month", c("o_orderdate")), 1, by="month").cast("timestamp_ntz"), "(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::TIMESTAMP"),
})
_TWO_ITEMS = lambda: call("json_array", c("event_id"), c("event_type"))
_FIVE = lambda: call("json_array", c("event_id") % 5, F.lit(7))
_family("fn_json_more", "events", ["event_id"], {
    "f_scalar": (lambda: call("json_extract_scalar", c("props"), "$.k"), "json_extract_string(props, '$.k')"),
    "f_insert": (lambda: call("json_insert", c("props"), "$.z", "1"), "json_merge_patch(props, '{\"z\":1}')::VARCHAR"),
    "f_replace": (lambda: call("json_replace", c("props"), "$.k", "5"), "json_merge_patch(props, '{\"k\":5}')::VARCHAR"),
    "f_unquote": (lambda: call("json_unquote", call("json_quote", c("event_type"))), "event_type"),
    "f_search": (lambda: call("json_search", call("json_object", "t", c("event_type")), "one", "c%"), "CASE WHEN event_type LIKE 'c%' THEN '\"$.t\"' END"),
    "f_size": (lambda: call("json_storage_size", _TWO_ITEMS()), "strlen(json_array(event_id, event_type)::VARCHAR)::INT"),
    "f_append": (lambda: call("json_array_append", _TWO_ITEMS(), "$", "9"), "json_array(event_id, event_type, 9)::VARCHAR"),
    "f_array_insert": (lambda: call("json_array_insert", _TWO_ITEMS(), "$[0]", "9"), "json_array(9, event_id, event_type)::VARCHAR"),
    "f_member": (lambda: call("json_member_of", "3", _FIVE()), "(event_id % 5 = 3)::INT"),
    "f_overlaps": (lambda: call("json_overlaps", _FIVE(), "[3,9]"), "(event_id % 5 = 3)::INT"),
    "f_contains": (lambda: call("json_contains", _FIVE(), "3"), "(event_id % 5 = 3)::INT"),
    "f_preserve": (lambda: call("json_merge_preserve", call("json_object", "id", c("event_id")), '{"t":1}'), "json_object('id', event_id, 't', 1)::VARCHAR"),
    "f_pretty": (lambda: call("json_pretty", call("json_object", "id", c("event_id"))), "printf('{\n  \"id\": %d\n}', event_id)"),
})
_family("fn_unicode_more", "documents", ["doc_id"], {
    "f_nfd": (lambda: call("nfc", call("nfd", c("text"))), "nfc_normalize(text)"),
    "f_nfkd": (lambda: call("nfkc", call("nfkd", c("text"))), "nfc_normalize(text)"),
    "f_normalize": (lambda: call("unicode_normalize", c("text"), "NFC"), "nfc_normalize(text)"),
    "f_ascii": (lambda: call("transliterate", c("text"), "Latin-ASCII"), "strip_accents(text)"),
})
_family("fn_collation", "nation", ["n_nationkey"], {
    "f_compare": (lambda: call("icu_compare", c("n_name"), "india"), "CASE WHEN lower(n_name) < 'india' THEN -1 WHEN lower(n_name) > 'india' THEN 1 ELSE 0 END"),
    "f_key": (lambda: call("icu_sort_key", c("n_name")), "lower(hex(lower(n_name)))"),
})

_N = "s_nationkey"
_point = lambda x, y: call("st_point", x, y)
_box = lambda *e: call("st_makeenvelope", *[F.lit(v) if not isinstance(v, Column) else v for v in e])
_line = lambda *p: F.concat(F.lit("LINESTRING("), *p, F.lit(")"))
_t = lambda: c(_N).cast("string")
_family("fn_spatial", "supplier", ["s_suppkey"], {
    "f_astext": (lambda: call("st_astext", _point(c(_N), F.lit(2))), f"'POINT(' || {_N} || ' 2)'"),
    "f_geomfromtext": (lambda: call("st_geomfromtext", F.concat(F.lit("point ( "), _t(), F.lit("  2 )"))), f"'POINT(' || {_N} || ' 2)'"),
    "f_aswkt": (lambda: call("st_aswkt", _box(0, 0, c(_N) + 1, 2)), f"printf('POLYGON((0 0, %d 0, %d 2, 0 2, 0 0))', {_N} + 1, {_N} + 1)"),
    "f_srid": (lambda: call("st_srid", F.concat(F.lit("SRID="), _t(), F.lit(";POINT(1 2)"))), f"{_N}::INT"),
    "f_type": (lambda: call("st_geometrytype", F.when(c(_N) < 10, _point(c(_N), F.lit(1))).otherwise(_box(0, 0, 1, 1))), f"CASE WHEN {_N} < 10 THEN 'Point' ELSE 'Polygon' END"),
    "f_dimension": (lambda: call("st_dimension", F.when(c(_N) < 10, _point(c(_N), F.lit(1))).otherwise(_box(0, 0, 1, 1))), f"CASE WHEN {_N} < 10 THEN 0 ELSE 2 END"),
    "f_empty": (lambda: call("st_isempty", F.when(c(_N) < 10, "POINT EMPTY").otherwise(_box(0, 0, 1, 1))), f"{_N} < 10"),
    "f_valid": (lambda: call("st_isvalid", F.when(c(_N) < 10, "POLYGON((0 0, 1 0, 0 0))").otherwise(_box(0, 0, 1, 1))), f"{_N} >= 10"),
    "f_points": (lambda: call("st_numpoints", F.when(c(_N) < 10, _point(c(_N), F.lit(1))).otherwise(_box(0, 0, 1, 1))), f"CASE WHEN {_N} < 10 THEN 1 ELSE 5 END"),
    "f_envelope": (lambda: call("st_envelope", _line(F.lit("0 0, "), (c(_N) + 1).cast("string"), F.lit(" 2"))), f"printf('POLYGON((0 0, %d 0, %d 2, 0 2, 0 0))', {_N} + 1, {_N} + 1)"),
    "f_y": (lambda: call("st_y", _point(F.lit(1), c(_N))), f"{_N}::DOUBLE"),
    "f_length": (lambda: call("st_length", _line(F.lit("0 0, "), _t(), F.lit(" 0"))), f"{_N}::DOUBLE"),
    "f_area": (lambda: call("st_area", _box(0, 0, c(_N) + 1, 3)), f"3.0 * ({_N} + 1)"),
    "f_perimeter": (lambda: call("st_perimeter", _box(0, 0, c(_N) + 1, 3)), f"2.0 * ({_N} + 4)"),
    "f_centroid": (lambda: call("st_centroid", _box(0, 0, c(_N) * 2 + 2, 2)), f"'POINT(' || ({_N} + 1) || ' 1)'"),
    "f_contains": (lambda: call("st_contains", _box(0, 0, 10, 4), _point(c(_N) + 0.5, F.lit(2))), f"{_N} < 10"),
    "f_within": (lambda: call("st_within", _point(c(_N) + 0.5, F.lit(2)), _box(0, 0, 10, 4)), f"{_N} < 10"),
    "f_intersects": (lambda: call("st_intersects", _box(c(_N), 0, c(_N) + 2, 2), _box(5.5, 1, 7.5, 3)), f"{_N} BETWEEN 4 AND 7"),
    "f_disjoint": (lambda: call("st_disjoint", _box(c(_N), 0, c(_N) + 2, 2), _box(5.5, 1, 7.5, 3)), f"{_N} NOT BETWEEN 4 AND 7"),
    "f_equals": (lambda: call("st_equals", _point(c(_N), F.lit(2)), "POINT(3 2)"), f"{_N} = 3"),
    "f_touches": (lambda: call("st_touches", _box(c(_N), 0, c(_N) + 1, 1), _box(3, 0, 4, 1)), f"{_N} IN (2, 3, 4)"),
    "f_overlaps": (lambda: call("st_overlaps", _box(c(_N) * 3, 0, c(_N) * 3 + 2, 2), _box(10.5, 0, 12.5, 2)), f"{_N} IN (3, 4)"),
    "f_crosses": (lambda: call("st_crosses", _line(_t(), F.lit(" 0, "), _t(), F.lit(" 4")), "LINESTRING(2.5 2, 6.5 2)"), f"{_N} BETWEEN 3 AND 6"),
    "f_buffer": (lambda: call("st_contains", call("st_buffer", _point(F.lit(0), F.lit(0)), 5.5), _point(c(_N), F.lit(0))), f"{_N} < 6"),
    "f_union": (lambda: call("st_numpoints", call("st_union", _point(c(_N), F.lit(2)), "POINT(0 0)")), "2"),
})


def query(name: str, oracle: str):
    def put(f):
        QUERIES[name], ORACLE[name] = f, oracle
        return f

    return put


@query("fn_vectors", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity, round(-list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS ip FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def fn_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    given = e.withColumn("o", e.where("vec_id = 0").select("embedding").scalar())
    return given.select("vec_id", F.round(call("cosine_similarity", c("embedding"), c("o")), 6).alias("similarity"), F.round(call("vec_ip_distance", c("embedding"), c("o")), 6).alias("ip"))


@query("aggregates_more", "SELECT role, to_json(list_sort(list(turn)))::VARCHAR AS turns, round(quantile_cont(length(text), 0.75), 4) AS p75, to_json(list_sort(list(DISTINCT conv_id)))::VARCHAR AS convs FROM conversations GROUP BY role")
def aggregates_more(spark, sf_dir):
    made = table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.to_json(F.sort_array(call("array_agg", c("turn")))).alias("turns"), F.round(call("percentile", F.char_length("text"), 0.75), 4).alias("p75"), F.to_json(F.sort_array(F.array_distinct(call("list", c("conv_id"))))).alias("convs")
    )
    return made


_docs = lambda spark, sf_dir: table(spark, sf_dir, "documents")
_ONE = "SELECT doc_id AS doc, 1.0::DOUBLE AS score FROM documents WHERE "
_FULLTEXT = {
    "ft_match_all": (fulltext.match_all, _ONE + "true"),
    "ft_match_none": (fulltext.match_none, _ONE + "false"),
    "ft_range": (lambda d: fulltext.in_range(d, "n_chars", 100, 2000, with_high=False), _ONE + "n_chars >= 100 AND n_chars < 2000"),
    "ft_exists": (lambda d: fulltext.exists(d, "lang"), _ONE + "lang IS NOT NULL"),
    "ft_term_set": (lambda d: fulltext.term_set(d, ["stupid", "trash", "license", "apache"], 2), _ONE + f"len(list_filter(list_distinct({_WORDS}), lambda w: w IN ('stupid', 'trash', 'license', 'apache'))) >= 2"),
    "ft_prefix": (lambda d: fulltext.prefix(d, "licen"), _ONE + f"len(list_filter({_WORDS}, lambda w: starts_with(w, 'licen'))) > 0"),
    "ft_phrase_prefix": (lambda d: fulltext.phrase_prefix(d, ["apache", "lic"]), _ONE + "regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])apache[^\\p{L}\\p{N}]+lic')"),
    "ft_regex": (lambda d: fulltext.regex(d, "l[a-z]c[a-z]+e"), _ONE + f"len(list_filter({_WORDS}, lambda w: regexp_full_match(w, 'l[a-z]c[a-z]+e'))) > 0"),
    "ft_nested": (lambda d: fulltext.nested(d.withColumn("parts", F.split("source", "c")), "parts", lambda p: p == "12"), _ONE + "list_contains(string_split(source, 'c'), '12')"),
    "ft_function_score": (lambda d: fulltext.function_score(fulltext.exists(d, "lang"), d, c("n_chars") / 1000), "SELECT doc_id AS doc, n_chars / 1000 AS score FROM documents WHERE lang IS NOT NULL"),
    "ft_const_score": (lambda d: fulltext.constant(fulltext.prefix(d, "licen"), 2.5), f"SELECT doc_id AS doc, 2.5::DOUBLE AS score FROM documents WHERE len(list_filter({_WORDS}, lambda w: starts_with(w, 'licen'))) > 0"),
    "ft_query_string": (lambda d: fulltext.run_query(d, "+license -apache stupid^2").select("doc", F.round("score", 6).alias("score")), _TWO + _scored("x", ["license"]) + ", " + _scored("y", ["stupid"])
        + " SELECT d.doc, round(coalesce(x.score, 0) + 2 * coalesce(y.score, 0), 6) AS score FROM d LEFT JOIN x USING (doc) LEFT JOIN y USING (doc) WHERE list_contains(w, 'license') AND NOT list_contains(w, 'apache')"),
    "ft_match_against": (lambda d: fulltext.match_against(d, "License, stupid!").select("doc", F.round("score", 6).alias("score")), _TWO + _scored("x", ["license", "stupid"]) + " SELECT doc, round(score, 6) AS score FROM x"),
}
for _name, (_f, _sql) in _FULLTEXT.items():
    query(_name, _sql)(lambda spark, sf_dir, f=_f: f(_docs(spark, sf_dir)))
