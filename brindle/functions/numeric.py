"""Math and financial functions: doubles in, doubles out, NULL for NULL."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import col, scalar, vectorized


def _d(c):
    return col(c).cast("double")


for _names, _f in {
    ("abs",): F.abs, ("sqrt",): F.sqrt, ("exp",): F.exp, ("log10",): F.log10, ("log2",): F.log2, ("ln",): F.ln,
    ("sin",): F.sin, ("cos",): F.cos, ("tan",): F.tan, ("asin",): F.asin, ("acos",): F.acos, ("atan",): F.atan, ("degrees",): F.degrees, ("radians",): F.radians,
    ("cbrt",): F.cbrt, ("cot",): F.cot, ("sinh",): F.sinh, ("cosh",): F.cosh, ("tanh",): F.tanh, ("asinh",): F.asinh, ("acosh",): F.acosh, ("atanh",): F.atanh, ("sign",): F.signum,
}.items():
    scalar(*_names)(lambda x, f=_f: f(_d(x)))
scalar("ceil", "ceiling")(lambda x: F.ceil(_d(x)).cast("double"))
scalar("floor")(lambda x: F.floor(_d(x)).cast("double"))
scalar("pow", "power")(lambda x, y: F.pow(_d(x), _d(y)))
scalar("atan2")(lambda y, x: F.atan2(_d(y), _d(x)))
scalar("pi")(lambda: F.lit(math.pi))
scalar("mod")(lambda a, b: F.when(_d(b) != 0, _d(a) % _d(b)))
scalar("factorial")(lambda n: F.factorial(n.cast("int")))
scalar("is_nan")(lambda x: F.isnan(_d(x)))
scalar("is_infinite")(lambda x: F.abs(_d(x)) == float("inf"))
scalar("is_finite")(lambda x: ~F.isnan(_d(x)) & (F.abs(_d(x)) != float("inf")))


@scalar("log")
def log(a, b=None):
    """Natural logarithm, or of ``b`` to the base ``a``."""
    return F.ln(_d(a)) if b is None else F.ln(_d(b)) / F.ln(_d(a))


@scalar("round")
def round_(x, digits=None):
    """Half away from zero."""
    scale = F.pow(F.lit(10.0), _d(digits)) if digits is not None else F.lit(1.0)
    return F.signum(_d(x)) * F.floor(F.abs(_d(x)) * scale + 0.5) / scale


@scalar("truncate", "round_truncate")
def truncate(x, digits=None):
    scale = F.pow(F.lit(10.0), _d(digits)) if digits is not None else F.lit(1.0)
    return F.signum(_d(x)) * F.floor(F.abs(_d(x)) * scale) / scale


scalar("rand")(lambda *seed: F.rand() if not seed else F.call_function("rand", seed[0]))


def _paired(f):
    """``f`` of two columns of 64-bit numbers, in Arrow batches; NULL where either is."""

    @vectorized
    @F.arrow_udf(T.LongType())
    def g(a: pa.Array, b: pa.Array) -> pa.Array:
        empty = pc.or_(pc.is_null(a), pc.is_null(b))
        x, y = (pc.fill_null(c, 0).to_numpy(zero_copy_only=False) for c in (a, b))
        return pc.if_else(empty, pa.scalar(None, pa.int64()), pa.array(f(x, y), pa.int64()))

    return lambda a, b: g(a.cast("long"), b.cast("long"))


scalar("gcd")(_paired(np.gcd))
scalar("lcm")(_paired(np.lcm))


@scalar("even")
def even(x):
    """The next even whole number away from zero."""
    return F.signum(_d(x)) * 2 * F.ceil(F.abs(_d(x)) / 2)


# --- financial ------------------------------------------------------------------------------------


def _growth(rate, nper):
    return F.pow(1 + rate, nper)


def _annuity(rate, nper, kind):
    return F.when(rate == 0, nper).otherwise((1 + rate * col(kind)) * (_growth(rate, nper) - 1) / F.when(rate == 0, 1).otherwise(rate))


@scalar("fv")
def fv(rate, nper, pmt, pv=0.0, kind=0):
    rate, nper = _d(rate), _d(nper)
    return -(_d(pv) * _growth(rate, nper) + _d(pmt) * _annuity(rate, nper, kind))


@scalar("pv")
def pv(rate, nper, pmt, fv=0.0, kind=0):
    rate, nper = _d(rate), _d(nper)
    return -(_d(fv) + _d(pmt) * _annuity(rate, nper, kind)) / _growth(rate, nper)


def _pmt(rate, nper, pv, fv=0.0, kind=0):
    rate, nper = _d(rate), _d(nper)
    return -(_d(fv) + _d(pv) * _growth(rate, nper)) / _annuity(rate, nper, kind)


scalar("pmt")(_pmt)


def _ipmt(rate, per, nper, pv, fv=0.0, kind=0):
    """Interest part of payment ``per``, payments at the end of a period unless ``kind`` is 1."""
    rate, per = _d(rate), _d(per)
    pay = _pmt(rate, nper, pv, fv, kind)
    owed = -(_d(pv) * _growth(rate, per - 1) + pay * _annuity(rate, per - 1, kind))
    part = owed * rate
    return F.when((per < 1) | (per > _d(nper)), None).when(col(kind) == 1, F.when(per == 1, 0.0).otherwise(part / (1 + rate))).otherwise(part)


scalar("ipmt")(_ipmt)
scalar("ppmt")(lambda rate, per, nper, pv, fv=0.0, kind=0: _pmt(rate, nper, pv, fv, kind) - _ipmt(rate, per, nper, pv, fv, kind))


@scalar("npv")
def npv(rate, *values):
    return sum((_d(v) / F.pow(1 + _d(rate), F.lit(float(i))) for i, v in enumerate(values, 1)), F.lit(0.0))


@scalar("nper")
def nper(rate, pmt, pv, fv=0.0, kind=0):
    rate, pmt, pv, fv = _d(rate), _d(pmt), _d(pv), _d(fv)
    level = pmt * (1 + rate * col(kind))
    return F.when(rate == 0, -(pv + fv) / pmt).otherwise(F.ln((level - fv * rate) / (pv * rate + level)) / F.ln(1 + rate))


scalar("sln")(lambda cost, salvage, life: (_d(cost) - _d(salvage)) / _d(life))
scalar("syd")(lambda cost, salvage, life, per: (_d(cost) - _d(salvage)) * (_d(life) - _d(per) + 1) / (_d(life) * (_d(life) + 1) / 2))


@scalar("ddb")
def ddb(cost, salvage, life, per, factor=2.0):
    """Declining balance; the book value never falls below the salvage value."""
    cost, salvage = _d(cost), _d(salvage)
    fall = lambda book: F.greatest(F.least(book * _d(factor) / _d(life), book - salvage), F.lit(0.0))
    before = F.aggregate(F.sequence(F.lit(0), per.cast("int") - 1), F.struct(cost.alias("book"), F.lit(0.0).alias("last")), lambda s, _: F.struct((s["book"] - fall(s["book"])).alias("book"), fall(s["book"]).alias("last")))
    return before["last"]


scalar("round_banker")(lambda x, digits: F.rint(_d(x) * F.pow(F.lit(10.0), _d(digits))) / F.pow(F.lit(10.0), _d(digits)))
scalar("round_currency")(lambda x, digits=2: round_(x, digits))
scalar("compound_interest")(lambda p, rate, n, years: _d(p) * F.pow(1 + _d(rate) / _d(n), _d(n) * _d(years)))
scalar("simple_interest")(lambda p, rate, years: _d(p) * _d(rate) * _d(years))
scalar("cagr")(lambda begin, end, years: F.pow(_d(end) / _d(begin), 1 / _d(years)) - 1)
scalar("roi")(lambda gain, cost: (_d(gain) - _d(cost)) / _d(cost) * 100)


def _flows(face, coupon, rate, years, freq):
    """Coupon, yield of a period, number of periods and periods of a year of a bond."""
    f = _d(freq.cast("int"))
    return _d(face) * _d(coupon) / f, _d(rate) / f, (years.cast("int") * freq.cast("int")), f


def _bond_sum(pay, y, n, face, weight):
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, t: s + weight(_d(t)) * (pay + F.when(t == n, _d(face)).otherwise(0.0)) / F.pow(1 + y, _d(t)))


@scalar("bond_price")
def bond_price(face, coupon, rate, years, freq):
    pay, y, n, _ = _flows(face, coupon, rate, years, freq)
    return _bond_sum(pay, y, n, face, lambda t: F.lit(1.0))


def _duration(face, coupon, rate, years, freq):
    pay, y, n, f = _flows(face, coupon, rate, years, freq)
    return _bond_sum(pay, y, n, face, lambda t: t / f) / _bond_sum(pay, y, n, face, lambda t: F.lit(1.0))


scalar("bond_duration")(_duration)
scalar("bond_mduration")(lambda face, coupon, rate, years, freq: _duration(face, coupon, rate, years, freq) / (1 + _d(rate) / _d(freq)))


@scalar("bond_convexity")
def bond_convexity(face, coupon, rate, years, freq):
    pay, y, n, f = _flows(face, coupon, rate, years, freq)
    return _bond_sum(pay, y, n, face, lambda t: t * (t + 1)) / (_bond_sum(pay, y, n, face, lambda t: F.lit(1.0)) * F.pow(1 + y, F.lit(2.0)) * f * f)


def solve(value, x: float = 0.1, steps: int = 100, tolerance: float = 1e-7):
    """A root of ``value`` by Newton's method with a numerical slope; None if it does not settle."""
    for _ in range(steps):
        try:
            v = value(x)
            slope = (value(x + 1e-6) - value(x - 1e-6)) / 2e-6
        except (ZeroDivisionError, OverflowError):
            return None
        if isinstance(v, complex) or isinstance(slope, complex) or abs(slope) < 1e-14:
            return None
        step = v / slope
        x -= step
        if abs(step) < tolerance:
            return x
    return None


def irr(flows: list[float], guess: float = 0.1):
    return solve(lambda r: sum(v / (1 + r) ** i for i, v in enumerate(flows)), guess)


def xirr(flows: list[float], days: list[float], guess: float = 0.1):
    return solve(lambda r: sum(v / (1 + r) ** ((d - days[0]) / 365.0) for v, d in zip(flows, days)), guess)


@vectorized
@F.pandas_udf(T.DoubleType())
def _irr(flows: pd.Series) -> pd.Series:
    return flows.map(lambda t: None if t is None else irr(json.loads(t))).astype("float64")


@vectorized
@F.pandas_udf(T.DoubleType())
def _xirr(flows: pd.Series, dates: pd.Series) -> pd.Series:
    day = lambda d: pd.Timestamp(d).toordinal()
    return pd.Series([None if a is None or b is None else xirr(json.loads(a), [day(d) for d in json.loads(b)]) for a, b in zip(flows, dates)], dtype="float64")


scalar("irr")(_irr)
scalar("xirr")(_xirr)


@vectorized
@F.pandas_udf(T.DoubleType())
def _rate(nper: pd.Series, pmt: pd.Series, pv: pd.Series, fv: pd.Series) -> pd.Series:
    return pd.Series([solve(lambda r: b * (1 + r) ** n + p * ((1 + r) ** n - 1) / (r or 1e-12) + f) for n, p, b, f in zip(nper, pmt, pv, fv)], dtype="float64")


scalar("rate")(lambda nper, pmt, pv, fv=0.0: _rate(_d(nper), _d(pmt), _d(pv), _d(fv)))


@vectorized
@F.pandas_udf(T.DoubleType())
def _yield(price: pd.Series, face: pd.Series, coupon: pd.Series, years: pd.Series, freq: pd.Series) -> pd.Series:
    def one(p, f, c, y, m):
        n = int(y) * int(m)
        return solve(lambda r: sum((f * c / m) / (1 + r / m) ** t for t in range(1, n + 1)) + f / (1 + r / m) ** n - p, c or 0.05)

    return pd.Series([one(*row) for row in zip(price, face, coupon, years, freq)], dtype="float64")


scalar("bond_yield")(lambda price, face, coupon, years, freq: _yield(_d(price), _d(face), _d(coupon), _d(years), _d(freq)))
