"""JSON functions on JSON texts; results that are JSON are JSON texts with sorted keys.

Paths are ``$``, ``.key``, ``."key"``, ``.*``, ``[n]``, ``[last]``, ``[last-n]``, ``[a to b]``, ``[*]``.
Work is done in Arrow batches; NULL or unreadable documents give NULL.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import scalar, vectorized

_STEP = re.compile(r"""\.\s*(?:(\*)|"((?:[^"\\]|\\.)*)"|([^\s.\[\]"]+))|\[\s*(?:(\*)|(last(?:\s*-\s*\d+)?|\d+)(?:\s+to\s+(last(?:\s*-\s*\d+)?|\d+))?)\s*\]""")
_BAD = object()
KINDS = {"string": T.StringType(), "int": T.IntegerType()}


def path_steps(path: str) -> list[tuple]:
    """Steps ('key', name), ('index', n), ('range', a, b), ('keys',) and ('items',); positions from the end are negative."""
    if not path.startswith("$"):
        raise ValueError(f"not a path: {path}")
    at, out = 1, []
    place = lambda t: -1 - int(re.sub(r"\D", "", t) or 0) if t.startswith("last") else int(t)
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"not a path: {path}")
        at = m.end()
        if m[1]:
            out.append(("keys",))
        elif m[2] is not None or m[3] is not None:
            out.append(("key", m[2] if m[2] is not None else m[3]))
        elif m[4]:
            out.append(("items",))
        elif m[6]:
            out.append(("range", place(m[5]), place(m[6])))
        else:
            out.append(("index", place(m[5])))
    return out


def find(value, steps) -> list:
    """All values that the steps reach."""
    found = [value]
    for kind, *arg in steps:
        after = []
        for v in found:
            if kind == "key":
                if isinstance(v, dict) and arg[0] in v:
                    after.append(v[arg[0]])
            elif kind == "keys":
                after += v.values() if isinstance(v, dict) else []
            elif kind == "items":
                after += v if isinstance(v, list) else []
            else:
                items = v if isinstance(v, list) else [v]
                a = arg[0] if arg[0] >= 0 else len(items) + arg[0]
                b = a if kind == "index" else arg[1] if arg[1] >= 0 else len(items) + arg[1]
                after += [items[i] for i in range(a, b + 1) if 0 <= i < len(items)]
        found = after
    return found


def change(value, steps, make, insert: bool, replace: bool):
    """``value`` with the place of ``steps`` set to ``make(old)``; ``make`` may give ``_BAD`` to remove it."""
    if not steps:
        return make(value) if replace else value
    (kind, *arg), rest = steps[0], steps[1:]
    if kind == "key" and isinstance(value, dict):
        key = arg[0]
        if key in value:
            new = change(value[key], rest, make, insert, replace)
            return {k: (new if k == key else v) for k, v in value.items() if not (k == key and new is _BAD)}
        if not rest and insert and (new := make(None)) is not _BAD:
            return {**value, key: new}
    elif kind == "index" and isinstance(value, list):
        i = arg[0] if arg[0] >= 0 else len(value) + arg[0]
        if 0 <= i < len(value):
            new = change(value[i], rest, make, insert, replace)
            return value[:i] + ([] if new is _BAD else [new]) + value[i + 1 :]
        if not rest and insert and i >= len(value) and (new := make(None)) is not _BAD:
            return [*value, new]
    elif kind == "index" and arg[0] == 0:
        return change(value, rest, make, insert, replace)
    return value


def contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(contains(x, b) for x in a)
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b


def merge_patch(a, b):
    """RFC 7396."""
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def merge_preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: merge_preserve(a[k], v) if k in a else v for k, v in b.items()}}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def depth(v) -> int:
    inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return 1 + max(map(depth, inner), default=0)


def kind_of(v) -> str:
    for kind, name in ((type(None), "NULL"), (bool, "BOOLEAN"), (dict, "OBJECT"), (list, "ARRAY"), (str, "STRING"), (int, "INTEGER")):
        if isinstance(v, kind):
            return name
    return "DOUBLE"


def search(v, like: str, every: bool, path: str = "$") -> list[str]:
    found = []
    if isinstance(v, str):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in like)
        found = [path] if re.fullmatch(pattern, v, re.S) else []
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        if found and not every:
            break
        found += search(x, like, every, f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]")
    return found if every else found[:1]


def dump(v) -> str:
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def load(text):
    try:
        return json.loads(text)
    except (ValueError, TypeError):
        return _BAD


def _udf(names: str, f, result: str = "string", read: int = 1):
    """Register ``f`` over texts; the first ``read`` arguments are read as JSON."""

    @vectorized
    @F.pandas_udf(KINDS[result])
    def g(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns):
            values = [load(x) if i < read else x for i, x in enumerate(row)]
            try:
                out.append(None if any(v is _BAD for v in values) or row[0] is None else f(*values))
            except (ValueError, IndexError):
                out.append(None)
        return pd.Series(out, dtype={"string": "object", "int": "Int32"}[result])

    def build(*args: Column) -> Column:
        return g(*(a.cast("string") for a in args))

    scalar(*names.split())(build)


def _many(make):
    """document, path, value, path, value, ... with values given as JSON texts or plain texts."""

    def f(doc, *rest):
        for path, value in zip(rest[::2], rest[1::2]):
            new = load(value)
            doc = make(doc, path_steps(path), value if new is _BAD else new)
        return dump(doc)

    return f


def _remove(doc, *paths):
    for p in paths:
        doc = change(doc, path_steps(p), lambda _: _BAD, False, True)
    return dump(doc)


def _extract(doc, *paths):
    found, several = [], len(paths) > 1
    for p in paths:
        steps = path_steps(p)
        several |= any(s[0] in ("keys", "items", "range") for s in steps)
        found += find(doc, steps)
    return None if not found else dump(found) if several else dump(found[0])


def _append(doc, *rest):
    for path, value in zip(rest[::2], rest[1::2]):
        new = load(value)
        new = value if new is _BAD else new
        doc = change(doc, path_steps(path), lambda old, new=new: [*old, new] if isinstance(old, list) else [old, new], False, True)
    return dump(doc)


def _array_insert(doc, *rest):
    for path, value in zip(rest[::2], rest[1::2]):
        new = load(value)
        new = value if new is _BAD else new
        *before, (kind, at) = path_steps(path)
        if kind == "index":
            doc = change(doc, before, lambda old, at=at, new=new: [*old[:at], new, *old[at:]] if isinstance(old, list) else old, False, True)
    return dump(doc)


def _contains_path(doc, how, *paths):
    hits = [bool(find(doc, path_steps(p))) for p in paths]
    return int(all(hits) if how.lower() == "all" else any(hits))


def _search(doc, how, like, *_):
    found = search(doc, like, how.lower() == "all")
    return None if not found else dump(found[0] if len(found) == 1 else found)


def _overlaps(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return int(any(k in b and b[k] == v for k, v in a.items()))
    x, y = (v if isinstance(v, list) else [v] for v in (a, b))
    return int(any(contains(p, q) and contains(q, p) for p in x for q in y))


def _folded(f):
    def g(first, *rest):
        for r in rest:
            first = f(first, r)
        return dump(first)

    return g


_udf("json_type", lambda v: kind_of(v))
_udf("json_extract", _extract)
_udf("json_contains", lambda a, b: int(contains(a, b)), "int", 2)
_udf("json_contains_path", _contains_path, "int")
_udf("json_search", _search)
_udf("json_set", _many(lambda d, s, v: change(d, s, lambda _: v, True, True)))
_udf("json_insert", _many(lambda d, s, v: change(d, s, lambda old: v, True, False)))
_udf("json_replace", _many(lambda d, s, v: change(d, s, lambda _: v, False, True)))
_udf("json_remove", _remove)
_udf("json_merge_preserve", _folded(merge_preserve), read=99)
_udf("json_merge_patch", _folded(merge_patch), read=99)
_udf("json_length", lambda v: len(v) if isinstance(v, (dict, list)) else 1, "int")
_udf("json_depth", depth, "int")
_udf("json_pretty", lambda v: json.dumps(v, indent=2, sort_keys=True, ensure_ascii=False))
_udf("json_storage_size", lambda v: len(dump(v).encode()), "int")
_udf("json_array_append", _append)
_udf("json_array_insert", _array_insert)
_udf("json_member_of", lambda v, a: int(any(contains(x, v) and contains(v, x) for x in (a if isinstance(a, list) else [a]))), "int", 2)
_udf("json_overlaps", _overlaps, "int", 2)
_udf("json_keys", lambda v: dump(sorted(v)) if isinstance(v, dict) else None)
scalar("json_valid")(lambda x: F.when(x.isNotNull(), F.try_parse_json(x).isNotNull().cast("int")))
_udf("json_quote", lambda t: dump(t), read=0)
scalar("json_unquote")(lambda x: F.when(x.rlike('^".*"$'), F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")).otherwise(x))


@scalar("json_array")
def json_array(*values):
    """Values of any types; NULL stays null."""
    return F.concat(F.lit("["), F.concat_ws(",", *(_item(v) for v in values)), F.lit("]"))


@scalar("json_object")
def json_object(*pairs):
    """key, value, ...; keys are constants or columns."""
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(_item(k.cast("string")), F.lit(":"), _item(v)) for k, v in zip(pairs[::2], pairs[1::2]))), F.lit("}"))


def _item(v: Column) -> Column:
    return F.when(v.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r'^\{"v":(.*)\}$', 1))
