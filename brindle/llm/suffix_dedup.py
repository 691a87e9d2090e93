"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of ``LENGTH`` bytes has an anchor, the place inside it where the hash of ``GRAM``
bytes is least (the rightmost of equals); equal strings have their anchors at equal places. A
suffix array thus needs the suffixes at anchors only, about 3 in 100 bytes. Starts with the same
anchor form a run; its key is the hash of the anchor's gram, its span the hash of all bytes that
the strings of the run cover.

Each task turns batches of documents into such sorted arrays and deals them out by key. A
receiving task keeps a family of levels: a new array is merge-scanned against the last level
while that is at most twice its size, so levels grow geometrically; of suffixes with equal key
and span only the earliest stays, the others are repeats over their whole run. Suffixes that
share a key but not the span match in part: for these alone the strings are compared one by one,
in a second family. Copies inside one batch are settled before anything is shuffled, so a passage
that stands in a third of all documents gives one row for each batch.

Null text is the empty text. A null doc_id counts as smaller than any other. Rows with equal
doc_id are ordered by the crc32 of their text; rows equal in both are one document, and each of
them gets its result. Texts under ``LENGTH`` bytes lose nothing; very long texts are cut into
segments that overlap. Extra columns are ignored, whatever their names.

The arrays are ordered by the hash of the gram at each anchor, not by the bytes that follow, and
runs and strings are told apart by two 64-bit hashes: to ship the 168 bytes that an anchor's
strings cover would be about five times the text. It is a stand-in for suffixes in byte order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import crc32, mix64, partitions, text_bytes, written

LENGTH, GRAM = 100, 32
#: Bytes of documents made into one suffix array; bytes of documents whose entries a receiving task is to get.
BATCH, TASK_BYTES = 2 << 20, 64 << 20
_NULL = -(1 << 63)
_LOW = np.uint64((1 << 24) - 1)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64))
_ODD = mix64(np.arange(1001, 1033, dtype=np.uint64)) | np.uint64(1)
_FIELDS = (("key", "<u8"), ("span", "<u8"), ("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("n", "u1"))


def _grams(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the 32 bytes from each place on, by doubling."""
    h = _TABLE[data]
    step = 1
    while step < GRAM:
        h = h[:-step] * _ODD[step % 31] + h[step:]
        step *= 2
    return mix64(h)  # sums of mixed grams have no equal terms, unlike sums of the plain ones


def _window_hash(h: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Hash of the 100 bytes from each of the places ``q`` on."""
    return mix64(h[q] * _ODD[1] + h[q + 32] * _ODD[2] + h[q + 64] * _ODD[3] + h[q + LENGTH - GRAM] * _ODD[4])


def _second_hash(h: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Another hash of the same 100 bytes."""
    return mix64(h[q] * _ODD[13] + h[q + 32] * _ODD[14] + h[q + 64] * _ODD[15] + h[q + LENGTH - GRAM] * _ODD[16])


class Suffixes:
    """Columns of runs: key, span, doc, crc of its text, first start, number of starts."""

    __slots__ = [f for f, _ in _FIELDS]

    def __init__(self, *columns):
        for (f, t), c in zip(_FIELDS, columns):
            setattr(self, f, np.asarray(c, t))

    def __len__(self) -> int:
        return len(self.key)

    def take(self, i) -> "Suffixes":
        return Suffixes(*(getattr(self, f)[i] for f, _ in _FIELDS))

    @staticmethod
    def concat(parts: list["Suffixes"]) -> "Suffixes":
        return Suffixes(*(np.concatenate([getattr(p, f) for p in parts]) if parts else [] for f, _ in _FIELDS))

    def pack(self) -> bytes:
        import zstandard

        body = b"".join(np.ascontiguousarray(getattr(self, f)).view(np.uint8).reshape(len(self), -1).T.tobytes() if f in ("doc", "crc", "at") else getattr(self, f).tobytes() for f, _ in _FIELDS)
        return zstandard.ZstdCompressor(level=1).compress(body)

    @staticmethod
    def unpack(blob: bytes, n: int) -> "Suffixes":
        import zstandard

        body, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
        for f, t in _FIELDS:
            width = np.dtype(t).itemsize
            part = np.frombuffer(body, np.uint8, n * width, at)
            out.append((np.ascontiguousarray(part.reshape(width, n).T).view(t).ravel() if f in ("doc", "crc", "at") else part.view(t)).copy())
            at += n * width
        return Suffixes(*out)


def settle(s: Suffixes) -> tuple[Suffixes, Suffixes]:
    """Sort by key; of equal key and span keep the earliest. The kept and the repeated."""
    order = np.argsort(s.key, kind="stable")  # merges sorted stretches in linear time
    key = s.key[order]
    same = key[1:] == key[:-1]
    tied = np.zeros(len(s), bool)
    tied[1:] |= same
    tied[:-1] |= same
    if not tied.any():
        return s.take(order), s.take(slice(0, 0))
    i = order[tied]
    order[tied] = i[np.lexsort((s.at[i], s.crc[i], s.doc[i], s.span[i], s.key[i]))]
    s = s.take(order)
    later = np.zeros(len(s), bool)
    later[1:] = (s.key[1:] == s.key[:-1]) & (s.span[1:] == s.span[:-1])
    first = np.maximum.accumulate(np.where(later, 0, np.arange(len(s))))
    elsewhere = (s.doc != s.doc[first]) | (s.crc != s.crc[first]) | (s.at != s.at[first])  # else a repeated row
    return s.take(~later), s.take(later & elsewhere)


class Family:
    """Levels of settled suffix arrays of geometrically falling size."""

    def __init__(self):
        self.levels: list[Suffixes] = []

    def add(self, batch: Suffixes) -> list[Suffixes]:
        """Merge a settled array in; what it shows to be repeated."""
        repeated = []
        while self.levels and len(self.levels[-1]) <= 2 * len(batch):
            batch, again = settle(Suffixes.concat([self.levels.pop(), batch]))
            repeated.append(again)
        self.levels.append(batch)
        return repeated

    def close(self) -> tuple[Suffixes, list[Suffixes]]:
        """All levels as one array, and what that shows to be repeated."""
        whole, repeated = Suffixes.concat([]), []
        for level in reversed(self.levels):
            whole, again = settle(Suffixes.concat([level, whole]))
            repeated.append(again)
        return whole, repeated


def suffix_array(data: np.ndarray, owner: np.ndarray, base: np.ndarray, doc: np.ndarray, crc: np.ndarray) -> Suffixes:
    """The runs of a batch: ``data`` holds its documents' bytes, ``owner`` each byte's document number,
    ``base`` what to add to a place to get the start in the document."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return Suffixes.concat([])
    h = _grams(data)
    order = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    width, m = 1, order
    want = LENGTH - GRAM + 1
    while 2 * width <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (want - width)], m[want - width :])[:n]
    anchor = (_LOW - (m & _LOW)).astype(np.int64)
    inside = owner[:n] == owner[LENGTH - 1 :][:n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [n])) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    a = anchor[first]
    span = mix64(
        h[first] * _ODD[5] + h[first + 32] * _ODD[6] + h[first + 64] * _ODD[7] + h[last + 4] * _ODD[8] + h[last + 36] * _ODD[9] + h[last + 68] * _ODD[10]
        + (last - first).astype(np.uint64) * _ODD[11] + (a - first).astype(np.uint64) * _ODD[12]
    )
    d = owner[first]
    return Suffixes(h[a], span, doc[d], crc[d], first + base[d], last - first + 1)


def _batches(rows, size: int = BATCH):
    """Groups of segments (doc, crc, offset, bytes) of about ``size`` bytes; long texts become segments that overlap by ``LENGTH`` - 1 bytes."""
    group, held = [], 0
    for doc, data in rows:
        if len(data) < LENGTH:
            continue
        c = crc32(data)
        for at in range(0, len(data) - LENGTH + 1, size):
            part = data[at : at + size + LENGTH - 1]
            group.append((doc, c, at, part))
            held += len(part)
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def _arrays(group):
    parts = [np.frombuffer(g[3], np.uint8) for g in group]
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    return np.concatenate(parts), np.repeat(np.arange(len(group)), sizes), np.array([g[2] for g in group]) - starts, np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.uint32), starts


_DEALT = "part int, n int, repeated boolean, blob binary"
_PLACED = "part int, partial boolean, n int, blob binary"
_FOUND = "doc long, crc long, partial boolean, blob binary"


def _deal(kept: Suffixes, again: Suffixes, parts: int):
    """Rows of one batch for the receiving tasks: its array, cut by key, and what is settled already."""
    rows = []
    for s, repeated in ((kept, False), (again, True)):
        to = (s.key >> np.uint64(33)) % np.uint64(parts)
        order = np.lexsort((s.at, s.doc, to))
        s, to = s.take(order), to[order]
        cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else []
        for a, b in zip(cuts, [*cuts[1:], len(to)]):
            rows.append((int(to[a]), int(b - a), repeated, s.take(slice(a, b)).pack()))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["part", "n", "repeated", "blob"])


_SPOT = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("at", "<u4"), ("n", "u1")])


def _spots(found: list[tuple[Suffixes, bool]], parts: int):
    """A row for each bucket of documents: the runs found in them."""
    rows = []
    for s, partial in found:
        spots = np.empty(len(s), _SPOT)
        for f in _SPOT.names:
            spots[f] = getattr(s, f)
        # By both, so that rows without an id are dealt out too.
        to = (mix64(spots["doc"].astype(np.int64).view(np.uint64) * _ODD[17] + spots["crc"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to, spots = to[order], spots[order]
        cuts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else []
        for a, b in zip(cuts, [*cuts[1:], len(to)]):
            rows.append((int(to[a]), partial, int(b - a), spots[a:b].tobytes()))
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.int32(), pa.binary()))], names=["part", "partial", "n", "blob"])


def _by_document(batches):
    """A row for each document of a bucket, and each kind: its runs."""
    held: dict[bool, list] = {False: [], True: []}
    for b in batches:
        for partial, blob in zip(b.column("partial").to_pylist(), b.column("blob").to_pylist()):
            held[partial].append(np.frombuffer(blob, _SPOT))
    for partial, blobs in held.items():
        if not blobs:
            continue
        spots = np.concatenate(blobs)
        spots = spots[np.lexsort((spots["crc"], spots["doc"]))]
        cuts = np.flatnonzero(np.concatenate(([True], (spots["doc"][1:] != spots["doc"][:-1]) | (spots["crc"][1:] != spots["crc"][:-1]))))
        for i in range(0, len(cuts), 10_000):
            first = cuts[i : i + 10_000]
            ends = [*cuts[i + 1 : i + 10_001].tolist(), len(spots)]
            columns = [pa.array(spots["doc"][first].astype(np.int64)), pa.array(spots["crc"][first].astype(np.int64)), pa.array([partial] * len(first)), pa.array([spots[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "crc", "partial", "blob"])


def _receive(partial: bool, parts: int):
    """The receiving task: feeds its arrays to a family and reports repeats and, if asked for, partial matches."""

    def rows(batches):
        family, out, held = Family(), [], 0
        for b in batches:
            for n, repeated, blob in zip(b.column("n").to_pylist(), b.column("repeated").to_pylist(), b.column("blob").to_pylist()):
                s = Suffixes.unpack(blob, n)
                found = [s] if repeated else family.add(settle(s)[0])
                out += [(f, False) for f in found if len(f)]
                held += sum(map(len, found))
                if held > 500_000:
                    yield _spots([(Suffixes.concat([f for f, _ in out]), False)], parts)
                    out, held = [], 0
        whole, found = family.close()
        out = [(Suffixes.concat([f for f, _ in out] + found), False)]
        if partial and len(whole):
            same = whole.key[1:] == whole.key[:-1]
            tied = np.zeros(len(whole), bool)
            tied[1:] |= same
            tied[:-1] |= same
            out.append((whole.take(tied), True))
        yield _spots(out, parts)

    return rows


def _unpacked(blobs) -> np.ndarray:
    """The (start, count) rows of a document's blobs."""
    return np.concatenate([np.frombuffer(b, _SPOT) for b in blobs])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(data: bytes, rows: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and what is left."""
    order = np.argsort(rows["at"], kind="stable")
    start = rows["at"][order].astype(np.int64)
    stop = np.maximum.accumulate(start + rows["n"][order] + LENGTH - 1)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    a = start[new]
    b = stop[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(stop) - 1]))]
    edges = [0, *np.stack((a, b), 1).ravel().tolist(), len(data)]
    return int((b - a).sum()), len(a), b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _results(batches):
    for b in batches:
        out = []
        for doc_id, data, blobs in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text")), b.column("blobs").to_pylist()):
            removed, spans, kept = 0, 0, data
            if blobs:
                removed, spans, kept = _kept(data, _unpacked(blobs))
            out.append((doc_id, len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[f.split()[0] for f in RESULT.split(", ")])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), F.col("text").cast("string").alias("text"))
    size = given.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(partitions(spark), size // TASK_BYTES)

    def index(batches):
        rows = ((d, t) for b in batches for d, t in zip(b.column("doc").to_pylist(), text_bytes(b.column("text"))))
        for group in _batches(rows):
            yield _deal(*settle(suffix_array(*_arrays(group)[:5])), parts)

    def resolved(dealt: DataFrame, partial: bool) -> DataFrame:
        """Runs by document: dealt by key to the families, then by document."""
        return dealt.repartition(parts, "part").mapInArrow(_receive(partial, parts), _PLACED).repartition(parts, "part").mapInArrow(_by_document, _FOUND)

    found = written(resolved(given.select("doc", "text").mapInArrow(index, _DEALT), True), "repeats")

    # The same exchange of the texts serves both joins below.
    placed = given.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).repartition(parts, "doc", "crc")
    listed = lambda df: df.groupBy("doc", "crc").agg(F.collect_list("blob").alias("blobs"))

    def strings_of(batches):
        """The single strings of partly matching runs, as runs of one start."""

        def rows():
            for b in batches:
                for doc, c, data, blobs in zip(b.column("doc").to_pylist(), b.column("crc").to_pylist(), text_bytes(b.column("text")), b.column("blobs").to_pylist()):
                    for at, n in _unpacked(blobs)[["at", "n"]].tolist():
                        yield doc, c, at, data[at : at + n + LENGTH - 1]

        group, held = [], 0

        def flush():
            data, owner, base, doc, crc, starts = _arrays(group)
            h = _grams(data)
            n = np.array([len(g[3]) for g in group]) - LENGTH + 1
            d = np.repeat(np.arange(len(group)), n)
            q = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + starts[d]
            key = _window_hash(h, q)
            return _deal(*settle(Suffixes(key, _second_hash(h, q), doc[d], crc[d], q + base[d], np.ones(len(q)))), parts)

        for g in rows():
            group.append(g)
            held += len(g[3])
            if held >= BATCH:
                yield flush()
                group, held = [], 0
        if group:
            yield flush()

    partly = placed.join(listed(found.where("partial")), ["doc", "crc"]).select("doc_id", "doc", "crc", "text", "blobs")  # with all columns, so that the exchange is the same
    single = resolved(partly.mapInArrow(strings_of, _DEALT), False)
    whole = listed(found.where("not partial").select("doc", "crc", "blob").union(single.select("doc", "crc", "blob")))
    return placed.join(whole, ["doc", "crc"], "left").select("doc_id", "text", "blobs").mapInArrow(_results, RESULT)
