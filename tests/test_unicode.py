import unicodedata

import pytest
from pyspark.sql import functions as F

from brindle.functions import call

UNKNOWN = "Cn"  # ICU knows characters that Python's tables do not have yet


def bare(t):
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def test_forms_of_every_character_without_python_workers(spark):
    code = F.lpad(F.hex("id"), 8, "0")
    df = spark.range(0x20000).where("id < 55296 or id >= 57344").select(F.col("id"), F.concat(F.lit("a"), F.decode(F.unhex(code), "UTF-32"), F.lit("ẹ́")).alias("s"))
    forms = ("nfc", "nfd", "nfkc", "nfkd")
    out = df.select("s", *[call(f, F.col("s")).alias(f) for f in forms], call("strip_accents", F.col("s")).alias("bare"), call("unicode_normalize", F.col("s"), "nfkd").alias("n"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        if unicodedata.category(r["s"][1]) != UNKNOWN:
            want = tuple(unicodedata.normalize(f.upper(), r["s"]) for f in forms)
            assert tuple(r)[1:] == (*want, bare(r["s"]), want[3]), ascii(r["s"])


def test_forms_of_nothing_and_in_all_places(spark):
    df = spark.createDataFrame([(None, None), ("", "nfd"), ("é", ""), ("é", "NFD")], "s string, form string")
    s = F.col("s")
    assert [tuple(r) for r in df.select(call("nfc", s), call("strip_accents", s), call("unicode_normalize", s, F.col("form"))).collect()] == [(None, None, None), ("", "", ""), ("é", "e", "é"), ("é", "e", "é")]
    assert df.agg(F.countDistinct(call("nfc", s))).first()[0] == 2
    other = df.select(F.col("s").alias("t"))
    assert df.join(other, call("nfc", s) == call("nfc", F.col("t"))).count() == 5
    with pytest.raises(Exception, match="normalization form"):
        df.select(call("unicode_normalize", s, "other")).collect()
