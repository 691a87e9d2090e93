"""Names of scalar functions and what builds their columns."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]
SCALAR: dict[str, Builder] = {}
AGGREGATE: dict[str, Builder] = {}
#: Vectorised Python functions by the name that SQL texts call them by; whether builders call them so.
VECTORIZED: dict[str, Callable] = {}
BY_NAME: ContextVar[bool] = ContextVar("by_name", default=False)


def vectorized(udf: Callable) -> Callable:
    """Let builders use ``udf`` in columns and, while ``BY_NAME`` is set, in the texts of columns."""
    name = f"brindle_python_{len(VECTORIZED)}"
    VECTORIZED[name] = udf

    def apply(*columns) -> Column:
        return F.call_function(name, *columns) if BY_NAME.get() else udf(*columns)

    return apply


def col(x) -> Column:
    """A column as given, or a literal of any other value (also of text)."""
    return x if isinstance(x, Column) else F.lit(x)


def scalar(*names: str):
    """Register a builder under each name; its arguments become columns."""

    def put(f: Builder) -> Builder:
        def build(*args, **options) -> Column:
            return f(*(col(a) for a in args), **options)

        build.__name__, build.__doc__ = names[0], f.__doc__
        build.category = f.__module__.rpartition(".")[2]
        for n in names:
            SCALAR[n] = build
        return build

    return put


def aggregate(*names: str):
    def put(f: Builder) -> Builder:
        for n in names:
            AGGREGATE[n] = f
        return f

    return put


def call(name: str, *args, **options) -> Column:
    """The column of a scalar function or aggregate by its name."""
    key = name.lower()
    if key in SCALAR:
        return SCALAR[key](*args, **options)
    if key in AGGREGATE:
        return AGGREGATE[key](*(col(a) for a in args), **options)
    raise KeyError(f"no function {name}")


def alias(new: str, old: str) -> None:
    """Make ``new`` another name of a function."""
    for kind in (SCALAR, AGGREGATE):
        if old.lower() in kind:
            kind[new.lower()] = kind[old.lower()]
            return
    raise KeyError(f"no function {old}")


def search(word: str) -> list[str]:
    """Names of functions that contain ``word``, or whose documentation does, in order."""
    w = word.lower()
    return sorted({n for kind in (SCALAR, AGGREGATE) for n, f in kind.items() if w in n or w in (f.__doc__ or "").lower()})


def describe(name: str) -> dict[str, str]:
    """Name, kind, category (the module that defines it) and documentation of a function."""
    key = name.lower()
    for kind, functions in (("scalar", SCALAR), ("aggregate", AGGREGATE)):
        if key in functions:
            f = functions[key]
            return {"name": key, "kind": kind, "category": getattr(f, "category", f.__module__.rpartition(".")[2]), "doc": f.__doc__ or ""}
    raise KeyError(f"no function {name}")
