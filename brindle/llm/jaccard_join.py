"""Exact Jaccard join of 5-word shingle sets by a size-aware heavy-light split.

Equal sets are one class. Small (light) sets enumerate their subsets of the fixed sizes that a
link needs: two of them link exactly if they share such a subset. Large (heavy) sets are found by
scanning inverted lists, of the shingles that stand first in each set when the frequent ones are
put last, the most frequent at the end: how many of these a linked pair shares at least follows from the sizes. The boundary
between light and heavy is chosen by cost from a census of all documents: the number of sets of
each size and the length of the inverted list that an entry stands in.

Listed sets of about one size whose first two listed shingles are equal are a group: near copies
mostly are, others hardly ever. A list holds a group once and gives pairs of groups, so that many
near copies of a text give no pairs among themselves; a pair of groups shares all the lists that
any two of their members share. Long inverted lists give links to the smallest member of each
range of sizes instead of all pairs. Groups, pairs of them sharing enough listed shingles and these
links join classes into blocks; within a block all sets are compared exactly, first with a few
leaders, then, for what these left apart, by counting common shingles over the block's own lists. Blocks over ``BLOCK`` shingles are dealt out as pairs of
parts. So no pair of different texts is lost, and no group's pairs are all written.

Words are what stands between ASCII spaces after lower-casing A-Z. A text with fewer than five
words is one shingle; a null, empty or blank text has the empty set, links with nothing and is
its own component. Very long texts are taken whole. Repeated rows are members of one class; a
null doc_id never names a component with other ids. Extra columns are ignored, whatever their
names. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._util import mix64, partitions, releasing, text_bytes, text_slices, written
from .components import UnionFind, components

WORDS, PERCENT = 5, 80
#: Listed shingles that every heavy pair shares, at least, and as a part of the set; longest list of which all pairs are given.
SHARED, SHARE, LONG = 3, 16, 256
#: A shingle is frequent from this count on, as long as there are no more of them than ``RANKED``; then from the least count that leaves so many.
FREQUENT, RANKED = 8, 1 << 20
#: Steps of counts to a doubling, by which that count is chosen.
STEPS = 8
#: Sizes of a group differ by less than one part in ``SPAN``. A long list links sizes up to ``WIDE`` percent of the smallest to one member: 100 / PERCENT, times that difference.
SPAN, WIDE = 20, 132
#: Work of a list entry as against an enumerated subset; largest light size that is considered.
LIST_COST, LARGEST_LIGHT = 2.0, 20
#: Shingles compared in one task; bytes of text worked on at once; hashes counted at once.
BLOCK, CHUNK, COUNTED = 1 << 20, 1 << 20, 2 << 20
#: Bytes of dealt entries that a task is to get; entries scanned at once; links held before they are handed on.
TASK_BYTES, SCANNED, HELD = 32 << 20, 1 << 18, 1 << 18

_TABLE = mix64(np.arange(5001, 5257, dtype=np.uint64))
_PLACE = mix64(np.arange(6001, 6001 + WORDS, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def least_size(n: int) -> int:
    """Smallest set that can link with one of ``n``."""
    return -(-PERCENT * n // 100)


def needed(n: int, m: int) -> int:
    """Common elements that sets of ``n`` and ``m`` need for a link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def prefix(n: int) -> int:
    """Listed shingles of a heavy set of ``n``."""
    return min(n, n - least_size(n) + max(SHARED, n // SHARE))


def least_shared(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Common listed shingles that sets of ``n`` and ``m`` have if they link.

    Up to where the first of the two listings ends in the common order, all common shingles are
    listed in both; beyond, there are at most as many as that set has left.
    """
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    rest = lambda k: k - np.minimum(k, k + (-PERCENT * k // 100) + np.maximum(SHARED, k // SHARE))
    return np.maximum(need - np.maximum(rest(n), rest(m)), 1)


def least_shared_within(least: np.ndarray, most: np.ndarray, least2: np.ndarray, most2: np.ndarray) -> np.ndarray:
    """The least of ``least_shared`` for any sizes from ``least`` to ``most`` and from ``least2`` to ``most2``, or less."""
    need = -(-PERCENT * (least + least2) // (100 + PERCENT))
    # What is left of a set rises with its size, but for steps back by one.
    rest = lambda a, b: b - np.minimum(b, b + (-PERCENT * b // 100) + np.maximum(SHARED, b // SHARE)) + (a < b)
    return np.maximum(need - np.maximum(rest(least, most), rest(least2, most2)), 1)


def group_of(listing: np.ndarray, n: int) -> int:
    """A signed 64-bit name of the group of a set of ``n`` with this listing."""
    two = np.zeros(3, np.uint64)
    two[: min(2, len(listing))] = listing[:2]
    two[2] = int(np.log(n) / np.log1p(1 / SPAN))
    return int(mix64(np.array([(mix64(two) * _PLACE[:3]).sum(dtype=np.uint64)])).view(np.int64)[0])


def subset_sizes(n: int, most: int) -> list[int]:
    return sorted({needed(n, m) for m in range(least_size(n), min(most, 100 * n // PERCENT) + 1)})


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The light size of least cost, for numbers of sets by size and the mean length of the list that an entry stands in.

    Sets up to it enumerate subsets; those that can link with a larger one are listed.
    """
    listed = lambda light: sum(count * prefix(n) for n, count in sizes.items() if n >= least_size(light + 1)) * LIST_COST * list_length
    enumerated = lambda light: sum(count * sum(comb(n, c) for c in subset_sizes(n, light)) for n, count in sizes.items() if n <= light)
    return min(range(1, LARGEST_LIGHT + 1), key=lambda light: listed(light) + enumerated(light))


def least_frequent(steps: dict[int, int]) -> int:
    """The count from which on a shingle is frequent, for numbers of shingles by step of their count.

    The counts that still give long lists do not rise with the corpus, so neither may this one:
    the lists of shingles between the two would chain texts that have nothing else in common.
    """
    least, seen = 1 << 62, 0
    for k in sorted(steps, reverse=True):
        seen += steps[k]
        if seen > RANKED or 2 ** ((k + 1) / STEPS) <= FREQUENT:
            break
        least = ceil(2 ** (k / STEPS))
    return max(least, FREQUENT)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64) + 1
    space = _SPACE[data]
    word = ~space
    start = np.flatnonzero(word & np.concatenate(([True], space[:-1])))
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    stop = np.flatnonzero(word & np.concatenate((space[1:], [True]))) + 1
    length = stop - start
    at = np.flatnonzero(word)
    place = at - np.repeat(start, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    begins = np.cumsum(length) - length
    words = mix64(np.add.reduceat(_TABLE[data[at]] * power[place], begins) + length.astype(np.uint64))
    cuts = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    n = len(words) - WORDS + 1
    hashes = np.zeros(0, np.uint64)
    if n > 0:
        hashes = np.full(n, WORDS, np.uint64)
        for k in range(WORDS):
            hashes += words[k : k + n] * _PLACE[k]
        hashes = mix64(hashes)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(hashes[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix64(np.array([(words[a:b] * _PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 for the empty set."""
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else 0


def _chunks(batches, *others: str):
    """Lists of rows (other columns..., text bytes) of about ``CHUNK`` bytes."""
    rows, held = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in others), text_bytes(b.column("text"))):
            rows.append(row)
            held += len(row[-1])
            if held >= CHUNK:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


_CENSUS = "doc_id long, n long, class long, shingle long, times long"


def _census(batches):
    """A row for each document, and the shingles that several of a task's documents hold."""
    waiting: list[np.ndarray] = []
    held = 0

    def counts():
        u, c = np.unique(np.concatenate(waiting), return_counts=True)
        u, c = u[c > 1], c[c > 1]
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=[f.split()[0] for f in _CENSUS.split(", ")])

    for rows in _chunks(batches, "doc_id"):
        sets = shingle_sets([r[-1] for r in rows])
        names = [class_of(s) for s in sets]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), none, none], names=[f.split()[0] for f in _CENSUS.split(", ")]
        )
        own = list(dict(zip(names, sets)).values())  # copies count once
        waiting += own
        held += sum(map(len, own))
        if held >= COUNTED:
            yield counts()
            waiting, held = [], 0
    if waiting:
        yield counts()


_DEALT = "part int, kind int, n int, blob binary"
_LISTED, _SUBSET, _PAIR, _SURE, _CHAIN, _MEMBER = 0, 1, 2, 3, 4, 5


def _rows(found: list[tuple[np.ndarray, int, np.ndarray]]):
    """A batch of dealt rows from (part of each entry, kind, entries as a structured array)."""
    out = []
    for part, kind, entries in found:
        order = np.argsort(part, kind="stable")
        part, entries = part[order], entries[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
        out += [(int(part[a]), kind, int(b - a), entries[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(part)])]
    columns = list(zip(*out)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["part", "kind", "n", "blob"])


_ENTRY = np.dtype([("key", "<u8"), ("name", "<i8"), ("n", "<u4")])
_LINK = np.dtype([("a", "<i8"), ("b", "<i8"), ("need", "<u4")])


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _in_ranges(blobs: list[bytes], kind: np.dtype, field: str):
    """The entries of ``blobs``, about ``SCANNED`` at a time; entries with equal ``field`` come together."""
    arrays = [np.frombuffer(b, kind) for b in blobs]
    ranges = max(1, -(-sum(map(len, arrays)) // SCANNED))
    for r in range(ranges):
        yield np.concatenate([a if ranges == 1 else a[(mix64(a[field].view(np.uint64)) >> np.uint64(40)) % np.uint64(ranges) == r] for a in arrays])


def _lists(frequent, parts: int, light: int):
    """Entries of the inverted lists (groups of heavy sets), the members of these groups, and the enumerated subsets (sets of up to ``light``)."""

    def rows(batches):
        common, level = frequent.value
        for chunk in _chunks(batches):
            sets = {class_of(s): s for s in shingle_sets([r[-1] for r in chunk]) if len(s)}
            listed, subsets, members = [], [], []
            for name, s in sets.items():
                n = len(s)
                if n >= least_size(light + 1):
                    k = prefix(n)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        often = common[at] == s
                        if often.any():
                            s = s[np.argsort(np.where(often, level[at], 0), kind="stable")]
                    listed.append((group_of(s[:k], n), n, s[:k]))
                    members.append((listed[-1][0], name))
                if n <= light:
                    mixed = mix64(sets[name])
                    for c in subset_sizes(n, light):
                        keys = mix64(np.array([mixed[list(x)].sum(dtype=np.uint64) for x in combinations(range(n), c)], np.uint64) + np.uint64(c << 48))
                        subsets.append((name, n, c, keys))
            found = []
            for kind, entries in ((_LISTED, listed), (_SUBSET, subsets)):
                if entries:
                    e = np.zeros(sum(len(x[-1]) for x in entries), _ENTRY)
                    size = [len(x[-1]) for x in entries]
                    e["key"] = np.concatenate([x[-1] for x in entries])
                    e["name"] = np.repeat([x[0] for x in entries], size)
                    e["n"] = np.repeat([x[1] + (x[2] << 16 if kind == _SUBSET else 0) for x in entries], size)
                    found.append((_part(e["key"], parts), kind, e))
            if members:
                e = np.zeros(len(members), _LINK)
                e["a"], e["b"] = [x[1] for x in members], [x[0] for x in members]
                found.append((np.full(len(e), _part(e["b"][:1].view(np.uint64), parts)[0]), _MEMBER, e))
            yield _rows(found)

    return rows


def _scan(parts: int):
    """Scan the lists that came to this task: pairs of short lists, chains of long ones, sure links of subsets. Members of groups pass."""

    def rows(batches):
        by = {_LISTED: [], _SUBSET: [], _MEMBER: []}
        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist()):
                by[kind].append(blob)
        if by[_MEMBER]:
            yield _dealt_links({_MEMBER: [np.frombuffer(b"".join(by[_MEMBER]), _LINK)]}, parts)
        del by[_MEMBER]
        for kind, blobs in by.items():
            for e in _in_ranges(blobs, _ENTRY, "key") if blobs else ():
                e = e[np.lexsort((e["n"], e["name"], e["key"]))]
                again = np.zeros(len(e) + 1, bool)
                again[1:-1] = (e["key"][1:] == e["key"][:-1]) & (e["name"][1:] == e["name"][:-1])
                first = e[~again[:-1]]
                held, size = {}, 0
                for to, link in _listed(first, e["n"][~again[1:]].astype(np.int64)) if kind == _LISTED else _subsets(first):
                    held.setdefault(to, []).append(link)
                    size += len(link)
                    if size >= HELD:
                        yield _dealt_links(held, parts)
                        held, size = {}, 0
                if size:
                    yield _dealt_links(held, parts)

    return rows


def _dealt_links(held: dict[int, list[np.ndarray]], parts: int):
    found = []
    for to, links in held.items():
        x = np.concatenate(links)
        found.append((_part(mix64(x["a"].view(np.uint64) * np.uint64(3) + x["b"].view(np.uint64)), parts), to, x))
    return _rows(found)


def _cuts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key of the sorted entries begins, and how many entries it has."""
    cuts = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1]))) if len(e) else np.zeros(0, np.int64)
    return cuts, np.diff(np.concatenate((cuts, [len(e)])))


def _listed(e: np.ndarray, most: np.ndarray):
    """Pairs of the short lists in sorted entries, chains of the long ones; sizes in a group are from ``e["n"]`` to ``most``."""
    cuts, size = _cuts(e)
    # All pairs of the short lists, by distance within the list.
    short = np.repeat((size > 1) & (size <= LONG), size)
    s, upper = e[short], most[short]
    for d in range(1, int(size[(size > 1) & (size <= LONG)].max(initial=1))):
        i = np.flatnonzero(s["key"][d:] == s["key"][:-d])
        if not len(i):
            break
        n, m = s["n"][i].astype(np.int64), s["n"][i + d].astype(np.int64)
        near = (100 * upper[i] >= PERCENT * m) & (100 * upper[i + d] >= PERCENT * n)
        i, n, m = i[near], n[near], m[near]
        link = np.zeros(len(i), _LINK)
        link["need"] = least_shared_within(n, upper[i], m, upper[i + d])
        link["a"], link["b"] = s["name"][i], s["name"][i + d]  # names rise within a list
        yield _PAIR, link
    for a, k in zip(cuts[size > LONG].tolist(), size[size > LONG].tolist()):
        members = e[a : a + k]
        members = members[np.argsort(members["n"], kind="stable")]
        # By size: all that can link with the smallest go to it, and so on from the next size.
        sizes, first = members["n"].astype(np.int64), 0
        to = np.zeros(k, np.int64)
        while first < k:
            end = int(np.searchsorted(sizes, WIDE * sizes[first] // 100, "right"))
            to[first:end] = first
            to[first] = max(first - 1, 0)  # neighbours may link over the edge of a range
            first = end
        link = np.zeros(k - 1, _LINK)
        link["a"], link["b"] = members["name"][1:], members["name"][to[1:]]
        yield _CHAIN, link[WIDE * sizes[to[1:]] >= 100 * sizes[1:]]


def _subsets(e: np.ndarray):
    """Sure links of the sets that share an enumerated subset."""
    cuts, size = _cuts(e)
    for a, k in zip(cuts[size > 1].tolist(), size[size > 1].tolist()):
        members = e[a : a + k]
        n, c = (members["n"] & 0xFFFF).astype(np.int64), int(members["n"][0] >> 16)
        first = int(np.argmin(n))
        # The smallest links with all that any member links with.
        near = (PERCENT * (n + n[first]) <= (100 + PERCENT) * c) & (np.arange(k) != first)
        link = np.zeros(int(near.sum()), _LINK)
        link["a"], link["b"] = members["name"][near], members["name"][first]
        yield _SURE, link


#: sure is null for a class and its group.
_EDGES = "a long, b long, sure boolean"


def _count(batches):
    """Pairs that share enough listed shingles, chains, sure links and members of groups."""
    by = {_PAIR: [], _SURE: [], _CHAIN: [], _MEMBER: []}
    for b in batches:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist()):
            by[kind].append(blob)
    for kind, blobs in by.items():
        for x in _in_ranges(blobs, _LINK, "a") if blobs else ():
            x = x[np.lexsort((x["b"], x["a"]))]
            first = np.flatnonzero(np.concatenate(([True], (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1]))))
            times = np.diff(np.concatenate((first, [len(x)])))
            if kind == _PAIR and len(x):
                first = first[times >= np.minimum.reduceat(x["need"], first)]
            x = x[first]
            sure = pa.nulls(len(x), pa.bool_()) if kind == _MEMBER else pa.array(np.full(len(x), kind == _SURE))
            yield pa.RecordBatch.from_arrays([pa.array(x["a"]), pa.array(x["b"]), sure], names=["a", "b", "sure"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def link_block(sets: list[np.ndarray], leaders: int = 8) -> UnionFind:
    """The components of the exact links among ``sets``."""
    found = UnionFind(len(sets))
    # Leaders: the first set of each group so far; most copies link with one of the latest few.
    first: list[int] = []
    for i, s in enumerate(sets):
        for j in first[-leaders:]:
            if _linked(s, sets[j]):
                found.join(i, j)
                break
        else:
            first.append(i)
    if len({found.find(i) for i in first}) == 1:
        return found
    # What is apart: count common shingles over the block's lists.
    size = np.array([len(s) for s in sets])
    key = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(key, kind="stable")
    place = np.empty(len(key), np.int64)
    place[order] = np.arange(len(key))
    lists = owner[order]
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    list_start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    at = 0
    for i, n in enumerate(size.tolist()):
        p = place[at : at + n]
        at += n
        before = p - list_start[p]  # owners rise within a list, so these hold the sets before i
        total = int(before.sum())
        if not total:
            continue
        index = np.repeat(list_start[p] - (np.cumsum(before) - before), before) + np.arange(total)
        common = np.bincount(lists[index], minlength=i)[:i]
        near = np.flatnonzero(100 * common >= PERCENT * (n + size[:i] - common))
        for j in near.tolist():
            found.join(i, j)
    return found


def _compare(batches):
    """Links of the blocks in a partition sorted by block."""

    def links(names, sets):
        found = link_block(sets)
        roots = [found.find(i) for i in range(len(sets))]
        return [(names[i], names[r]) for i, r in enumerate(roots) if i != r]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    last, names, sets, out = None, [], [], []
    for rows in _chunks(batches, "root", "i", "j", "class"):
        for (*block, name, _), found in zip(rows, shingle_sets([r[-1] for r in rows])):
            if class_of(found) != name:  # another text under the same doc_id
                continue
            if block != last:
                if len(sets) > 1:
                    out += links(names, sets)
                last, names, sets = block, [], []
            names.append(name)
            sets.append(found)
        if len(out) > 10_000:
            yield batch(out)
            out = []
    if len(sets) > 1:
        out += links(names, sets)
    yield batch(out)


def _labels(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every row of ``docs`` its doc_id, set size n and class (0 for the empty set); of every class that is linked with another its class, group (a class of it) and component_id."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    census = written(given.mapInArrow(releasing(_census), _CENSUS), "jaccard-census")
    members = census.where("class is not null").select("doc_id", "n", "class")
    total = members.agg(F.sum("n")).first()[0] or 0
    times = written(census.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")), "jaccard-times")
    step = F.floor(F.log2("times") * STEPS).cast("int")
    least = least_frequent({r["step"]: r["n"] for r in times.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()})  # of fixed number
    rows = times.where(F.col("times") >= least).select("shingle", F.floor(F.log2("times")).cast("byte").alias("level")).toArrow()  # about RANKED at most
    shingle = rows["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingle)
    frequent = spark.sparkContext.broadcast((shingle[order], rows["level"].to_numpy()[order]))
    # The mean length of the list of an entry, without the frequent shingles; sets by size, up to the largest of interest.
    longer = times.where(F.col("times") < least).agg(F.sum((F.col("times") - 1) * F.col("times"))).first()[0] or 0
    most = 100 * LARGEST_LIGHT // PERCENT + 1
    sizes = {r["n"]: r["count"] for r in members.where(F.col("n").between(1, most)).groupBy("n").count().collect()}
    light = boundary(sizes, 1 + longer / max(1, total))
    # About a third of all shingles are listed.
    parts = max(partitions(spark), total * _ENTRY.itemsize // (3 * TASK_BYTES))

    dealt = given.select("text").mapInArrow(releasing(_lists(frequent, parts, light)), _DEALT).repartition(parts, "part")
    edges = written(dealt.mapInArrow(releasing(_scan(parts)), _DEALT).repartition(parts, "part").mapInArrow(releasing(_count), _EDGES), "jaccard-edges")

    classes = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    # A group is named by one of its classes from here on.
    groups = edges.where("sure is null").select(F.col("a").alias("class"), F.col("b").alias("group"))
    one = written(groups.groupBy("group").agg(F.min("class").alias("one")), "jaccard-groups")
    inside = groups.join(one.hint("merge"), "group").where("class <> one").select(F.col("class").alias("a"), F.col("one").alias("b"))
    among = edges.where("not sure").select(F.col("a").alias("group"), "b").join(one.hint("merge"), "group").select(F.col("one").alias("a"), F.col("b").alias("group")).join(one.hint("merge"), "group").select("a", F.col("one").alias("b"))
    roots = components(inside.union(among), "jaccard-blocks")
    blocks = written(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(classes, F.col("node") == F.col("class")).select("class", "root", "first", "n"), "jaccard-classes")
    # A block too large for a task is cut in parts, and each pair of parts is compared.
    # The texts are shuffled at any size: the other side grows with the corpus.
    shares = blocks.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("shares"))
    part = F.pmod(F.xxhash64("class"), F.col("shares")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda k: F.struct(F.least(k, F.col("_p")).alias("i"), F.greatest(k, F.col("_p")).alias("j")))
    placed = blocks.join(shares, "root").withColumn("_p", part).select("class", "root", F.col("first").alias("doc_id"), tasks.alias("tasks"))
    # A class whose rows have no id is found by its text instead.
    unnamed = placed.where("doc_id is null").select("class", "root", "tasks")
    texts = given.where("doc_id is not null").join(placed.hint("merge"), "doc_id").select("class", "root", "tasks", "text")
    texts = texts.union(given.where("doc_id is null").select(_class_column(F.col("text")).alias("class"), "text").dropDuplicates(["class"]).join(unnamed.hint("merge"), "class").select("class", "root", "tasks", "text"))
    texts = texts.select("class", "root", F.explode("tasks").alias("_t"), "text").select("root", F.col("_t.i").alias("i"), F.col("_t.j").alias("j"), "class", "text")
    links = texts.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j", "class").mapInArrow(releasing(_compare), "a long, b long")
    joined = components(edges.where("sure").select("a", "b").union(links), "jaccard-links")
    whole = joined.union(joined.select(F.col("root").alias("node"), "root").distinct())
    named = whole.join(classes.select(F.col("class").alias("node"), "first"), "node")
    component = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return members, component.select(F.col("node").alias("class"), F.col("root").alias("group"), "component_id")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text)."""
    members, component = _labels(docs)
    held = members.where("n > 0")
    # Only classes of several rows or of several texts need a label. Both sides of the join are plain
    # exchanges, so that AQE can split a class that holds a large share of all rows.
    several = held.groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).join(component.select("class", "component_id"), "class", "left")
    label = written(several.where("rows > 1 or component_id is not null").select("class", F.coalesce("component_id", "first").alias("component_id")), "jaccard-names")
    named = held.join(label.hint("merge"), "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return named.union(members.where("n = 0").select("doc_id", "n", "doc_id"))


@F.arrow_udf(LongType())
def _class_column(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from releasing(_class_names)(columns)


def _class_names(columns):
    for column in columns:
        yield pa.array([class_of(s) for texts in text_slices(column, CHUNK) for s in shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts])], pa.int64())


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group of linked texts, with columns unchanged.

    The row with the smallest doc_id stays, of equal ids that of the class with the smallest name, of
    rows equal in both any one; a null id counts as larger than any other. Rows with different texts
    that are not linked all stay, whatever their ids. Rows without words are linked with nothing, so
    all of them stay.
    """
    members, component = _labels(docs)
    whole = members.where("n > 0").groupBy("doc_id", "class").agg(F.lit(1)).join(component.select("class", "group"), "class", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("class")))
    best = written(whole.groupBy(F.coalesce("group", "class").alias("group")).agg(first.alias("b")).select("b.unnamed", "b.id", "b.class"), "jaccard-kept")
    text, doc_id = F.col("_doc.text").cast("string"), F.col("_doc.doc_id").cast("long")
    # The rows go along as one column, so that their names meet none of this plan's.
    given = docs.select(F.struct(*docs.columns).alias("_doc"))
    blank = F.coalesce(text, F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    named = given.where(~blank).select("_doc", doc_id.isNull().alias("unnamed"), F.coalesce(doc_id, F.lit(0)).alias("id"), _class_column(text).alias("class"))
    keys = ["class", "id", "unnamed"]
    chosen = named.join(best.hint("merge"), keys, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))).where("_n = 1")
    return chosen.select("_doc").union(given.where(blank)).select("_doc.*")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: DuckDB SQL for the rows of ``jaccard_components``.
ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (x) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT a, b FROM p UNION SELECT p.a, r.c FROM p JOIN r ON p.b = r.doc_id)
SELECT s.doc_id, len(any_value(sh))::BIGINT AS n_shingles, coalesce(min(c), s.doc_id) AS component_id FROM s LEFT JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id
"""
