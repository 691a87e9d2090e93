"""Further names of the documented surface, most of them other names or argument orders of registered functions."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .registry import SCALAR, aggregate, col, scalar, vectorized
from .temporal import spark_pattern

for _names, _f in {
    ("bitwise_and",): lambda a, b: a.cast("long").bitwiseAND(b.cast("long")),
    ("bitwise_or",): lambda a, b: a.cast("long").bitwiseOR(b.cast("long")),
    ("bitwise_xor",): lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")),
    ("bitwise_not",): lambda a: F.bitwise_not(a.cast("long")),
    ("lshift",): lambda a, n: F.call_function("shiftleft", a.cast("long"), n.cast("int")),
    ("rshift",): lambda a, n: F.call_function("shiftright", a.cast("long"), n.cast("int")),
    ("weekday",): lambda t: F.weekday(t.cast("timestamp")),
    ("base64_encode",): lambda s: F.base64(s.cast("binary")),
    ("base64_decode",): lambda s: F.unbase64(s).cast("string"),
    ("hex_encode",): lambda s: F.lower(F.hex(s.cast("binary"))),
    ("hex_decode",): lambda s: F.unhex(s).cast("string"),
    ("sha256",): lambda s: F.sha2(s.cast("binary"), 256),
    ("sha512",): lambda s: F.sha2(s.cast("binary"), 512),
    ("json_extract_scalar",): lambda s, path: F.call_function("get_json_object", s, path),
    ("random",): lambda: F.rand(),
    ("cosine_similarity",): lambda a, b: 1 - SCALAR["vec_cosine_distance"](a, b),
    ("vec_ip_distance",): lambda a, b: -SCALAR["vec_inner_product"](a, b),
    ("column_type",): lambda x: F.typeof(x),
    ("uuid_short",): lambda: F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12),
    ("database",): lambda: F.current_database(),
    ("user",): lambda: F.user(),
    ("jaro_winkler",): lambda a, b: SCALAR["jaro_winkler_similarity"](a, b),
}.items():
    scalar(*_names)(_f)
aggregate("percentile")(lambda x, p: F.percentile(x, p))


def str_to_date(text, pattern: str):
    """The timestamp of a text by a constant pattern in %-letters; NULL where the text does not fit."""
    return F.try_to_timestamp(col(text), F.lit(spark_pattern(pattern)))


def timestampdiff(unit: str, start, end):
    """Whole units (a constant name) from start to end."""
    return F.timestamp_diff(unit.upper(), col(start).cast("timestamp"), col(end).cast("timestamp"))


# The first argument of these is taken as it is, not made a column.
SCALAR["str_to_date"], SCALAR["timestampdiff"] = str_to_date, timestampdiff


@vectorized
@F.arrow_udf(StringType())
def _hmac(data: pa.Array, key: pa.Array) -> pa.Array:
    one = lambda d, k: None if d is None or k is None else hmac.new(k.encode(), d.encode(), hashlib.sha256).hexdigest()
    return pa.array([one(d, k) for d, k in zip(data.to_pylist(), key.to_pylist())], pa.string())


scalar("hmac_sha256")(lambda data, key: _hmac(data.cast("string"), key.cast("string")))
