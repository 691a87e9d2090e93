"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words) and units after a number become typed placeholders. A
capitalised word at the start of a sentence may be a name or not, so each window has two keys:
one with such words as literals, one with them as placeholders; either may match. Windows of ``WINDOW`` template
tokens of the documents are hash-joined with those of the benchmark. For a document and an item the matches on one diagonal (same offset) are put
together, and those on neighbouring diagonals are chained in order (a word was put in or left
out, which shifts the offset by ``SHIFT`` at most at a time); they count if they cover enough of
the item's windows and if its slots are filled consistently: equal item values always meet equal
document values and different ones different ones. Matches whose slots all agree are ``exact``, the others ``reparameterised``.

The join is a map-side hash join: the benchmark's windows are broadcast in blocks of at most
``BLOCK_BYTES`` of item text, one pass over the documents for each block, so the broadcast is
bounded however large the benchmark is. As a match needs half of an item's windows, the join
looks up only the rarest of them, one more than may be missing; a window that very many items
share is thus seldom a key. Items found so are then compared by all their windows. Windows with
few literal tokens are matched literally.

Items shorter than the window use one window of their own length; items without a word match
nothing, nor do null or empty texts. Very long texts are searched whole. Repeated documents are
each reported; repeated items are each matched under their own id; null ids are kept. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import mix64, releasing, text_slices

#: Template tokens of a window; share of an item's windows that must match, exactly or with other slots.
WINDOW, EXACT_SHARE, TEMPLATE_SHARE = 8, 0.5, 0.8
#: Largest change of offset between neighbours of a chain, in pieces.
SHIFT = 8
#: Benchmark text of one broadcast block; bytes of text worked on at once; tokens of a worker's memo (speed and memory only).
BLOCK_BYTES, CHUNK, MEMO = 16 << 20, 1 << 20, 150_000

# Unit words.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s ms sec secs min mins h hr hrs day days week weeks month months year years hour hours minute minutes second seconds "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres "
    "dollar dollars euro euros cent cents percent degrees degree celsius fahrenheit kelvin volt volts watt watts joule joules newton newtons hz khz mhz ghz kb mb gb tb mph kph pa kpa mol".split()
)
LITERAL, NUMBER, UNIT, CAPITAL = 0, 1, 2, 3
PIECE = re.compile(r"\d+(?:[.,:/]\d+)*%?|[^\W\d_]+|_+")
_HOLDER = np.array([0, 0x9D2C5680F0A1B3C5, 0xC6BC279692B5CC83, 0xA24BAED4963EE407], np.uint64)
_POWER = mix64(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


class _Pieces:
    """Typed pieces of tokens between spaces; what a token holds is kept until the memo is full.

    A token is its place in ``index``; the arrays hold its first piece and number of pieces, and of
    each piece the hash, the kind and whether a sentence ends with it.
    """

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.arrays = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool)

    def learn(self, tokens) -> None:
        new = [t for t in tokens if t not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > MEMO:
            self.reset()
            new = list(tokens)
        sizes, hashes, kinds, ends = [], [], [], []
        for token in new:
            found = [token] if token.isalpha() else PIECE.findall(token)
            sizes.append(len(found))
            for p in found:
                low = p.lower()
                hashes.append(_word_hash(low))
                kinds.append(NUMBER if p[0].isdigit() else UNIT if low in UNITS else CAPITAL if p[0].isupper() else LITERAL)
                ends.append(False)
            if found and token.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":"):
                ends[-1] = True
        first, size, h, kind, end = self.arrays
        count = len(self.index)
        self.index.update(zip(new, range(count, count + len(new))))
        at = np.cumsum(sizes) - sizes + len(h)
        # A token may be as long as its text, so sizes are wide.
        self.arrays = (
            np.concatenate((first, at.astype(np.int64))), np.concatenate((size, np.array(sizes, np.int64))), np.concatenate((h, np.array(hashes, np.uint64))),
            np.concatenate((kind, np.array(kinds, np.int8))), np.concatenate((end, np.array(ends, bool))),
        )


def _stream(texts: list[str], pieces: _Pieces):
    """Owner, literal hash and template types (0: literal) of every piece of ``texts``, in order.

    The types are given twice: with capitals at the start of a sentence as literals, and as placeholders.
    """
    split = [t.split() for t in texts]
    pieces.learn(set().union(*split) if split else set())
    first, size, hashes, kinds, ends = pieces.arrays
    get = pieces.index.__getitem__
    ids = np.array([get(t) for s in split for t in s], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    n = size[ids] if len(ids) else np.zeros(0, np.int64)
    total = int(n.sum())
    at = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(total) if len(ids) else np.zeros(0, np.int64)
    owner = np.repeat(owner, n)
    h, kind, end = (hashes[at], kinds[at].copy(), ends[at]) if total else (np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool))
    starts = np.ones(total, bool)
    starts[1:] = end[:-1] | (owner[1:] != owner[:-1])
    before = np.zeros(total, bool)
    before[1:] = (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])
    kind[(kind == UNIT) & ~before] = LITERAL
    strict = kind.copy()
    strict[(kind == CAPITAL) & starts] = LITERAL
    return owner, h, strict, kind


def _windows(owner: np.ndarray, h: np.ndarray, kind: np.ndarray, length: int):
    """Hash of the window from each piece on, and whether it lies in one text."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    template = np.where(kind == LITERAL, h, _HOLDER[kind])
    loose, exact, literal = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int8)
    for k in range(length):
        loose += template[k : k + n] * _POWER[k]
        exact += h[k : k + n] * _POWER[k]
        literal += kind[k : k + n] == LITERAL
    few = 2 * literal < length
    out = mix64(np.where(few, exact + np.uint64(1), loose) + np.uint64(length << 32))
    return out, owner[:n] == owner[length - 1 :]


class Index:
    """The windows of a block of benchmark items.

    ``key`` and ``item`` hold the windows that are looked up. As a match needs ``EXACT_SHARE`` of an
    item's windows, those are the rarest of each item, one more than a match may leave out.
    """

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        owner, h, strict, kind = _stream([t for _, t in items], _Pieces())
        bounds = np.searchsorted(owner, np.arange(len(items) + 1))
        self.first, self.hash, self.kinds = bounds[:-1], h, (strict, kind)
        size = np.diff(bounds)
        self.length = np.minimum(size, WINDOW)
        self.windows = np.maximum(size - WINDOW + 1, 1)
        self.lengths = np.unique(self.length[self.length > 0]).tolist()
        #: Of the window that starts at each piece, its two keys.
        self.keys = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
        starts = np.zeros(len(h), bool)
        for length in self.lengths:
            w, inside = _windows(owner, h, strict, length)
            other, _ = _windows(owner, h, kind, length)
            use = np.flatnonzero(inside & (self.length[owner[: len(w)]] == length))
            starts[use] = True
            self.keys[0][use], self.keys[1][use] = w[use], other[use]
        at = np.flatnonzero(starts)
        of = owner[at]
        each, number, times = np.unique(np.concatenate((self.keys[0][at], self.keys[1][at])), return_inverse=True, return_counts=True)
        often = np.maximum(times[number[: len(at)]], times[number[len(at) :]])
        order = np.lexsort((at, often, of))  # the windows of each item, the rarest first
        begin = np.searchsorted(of, np.arange(len(items)))
        rank = np.arange(len(at)) - begin[of]
        least = np.ceil(EXACT_SHARE * self.windows).astype(np.int64)
        probe = at[order][rank <= (self.windows - least)[of]]
        key = np.concatenate((self.keys[0][probe], self.keys[1][probe]))
        item = np.concatenate((owner[probe], owner[probe]))
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        self.key, self.item = key[new], item[new]
        bits = 16
        while (1 << bits) < 16 * len(self.key) and bits < 26:
            bits += 1
        self.mask = np.uint64((1 << bits) - 1)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.key & self.mask).astype(np.int64)] = True

    def search(self, texts: list[str], pieces: _Pieces) -> list[tuple]:
        """(text number, item id, kind, coverage, windows, first piece) of the items that each text holds."""
        owner, h, strict, kind = _stream(texts, pieces)
        start = np.searchsorted(owner, np.arange(len(texts) + 1))
        keys, hits = {}, []
        for length in self.lengths:
            w, inside = _windows(owner, h, strict, length)
            if not len(w):
                continue
            other, _ = _windows(owner, h, kind, length)
            keys[length] = w, other
            for key, use in ((w, inside), (other, inside & (w != other))):
                maybe = np.flatnonzero(use & self.filter[(key & self.mask).astype(np.int64)])
                if len(maybe):
                    lo, hi = np.searchsorted(self.key, key[maybe], "left"), np.searchsorted(self.key, key[maybe], "right")
                    n = hi - lo
                    item = self.item[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                    of = np.repeat(owner[maybe], n)
                    hits.append(np.unique(np.stack((of, item), 1)[self.length[item] == length], axis=0))
        out = []
        for d, i in np.unique(np.concatenate(hits), axis=0).tolist() if hits else ():
            a, length = int(start[d]), int(self.length[i])
            b = int(start[d + 1]) - length + 1
            pieces_of = h[a : start[d + 1]]
            first, either = self._diagonals(i, *(k[a:b] for k in keys[length]))
            best = self._best(i, first, self.kinds[0], pieces_of) if first else None
            if either != first and not (best and best[1] == 1):
                more = self._best(i, either, self.kinds[1], pieces_of)
                best = more if more and not (best and best[1] >= more[1]) else best
            if best:
                out.append((d, self.ids[i], *best))
        return out

    def _diagonals(self, i: int, w: np.ndarray, other: np.ndarray) -> tuple[dict, dict]:
        """Places of item ``i`` by offset at which windows of a document with keys ``w`` and ``other`` match: by first keys alone, and by either key."""
        a = int(self.first[i])
        places = slice(a, a + int(self.windows[i]))
        strict, loose = (k[places] for k in self.keys)
        first, either = defaultdict(set), defaultdict(set)
        # A document's key meets either key of the item; first keys count for `first` only with each other.
        for key, with_first in ((w, True), (other, False)):
            for theirs, is_first in ((strict, True), (loose, False)):
                order = np.argsort(theirs, kind="stable")
                lo, hi = np.searchsorted(theirs, key, "left", order), np.searchsorted(theirs, key, "right", order)
                n = hi - lo
                p = np.repeat(np.arange(len(key)), n)
                j = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                for offset, place in zip((p - j).tolist(), j.tolist()):
                    either[offset].add(place)
                    if with_first and is_first:
                        first[offset].add(place)
        return first, either

    def _best(self, i: int, diagonals: dict[int, set[int]], kind: np.ndarray, h: np.ndarray) -> tuple | None:
        """(kind, coverage, windows, first piece) of the fullest consistent match of item ``i``, its slots by ``kind``, in a document with pieces ``h``."""
        windows, length, best = int(self.windows[i]), int(self.length[i]), None
        if len(set().union(*diagonals.values())) < EXACT_SHARE * windows:
            return None

        def consider(runs: list[tuple[int, list[int]]]) -> None:
            nonlocal best
            share = sum(len(places) for _, places in runs) / windows
            if share < EXACT_SHARE or best and best[1] >= share:
                return
            pairs = set()
            for offset, places in runs:
                covered = np.array(sorted({j + k for j in places for k in range(length)}))
                a = self.first[i] + covered
                slots = kind[a] != LITERAL
                pairs.update(zip(kind[a][slots].tolist(), self.hash[a][slots].tolist(), h[offset + covered][slots].tolist()))
            same = all(x == y for _, x, y in pairs)
            consistent = len({(k, x) for k, x, _ in pairs}) == len(pairs) == len({(k, y) for k, _, y in pairs})
            if same or consistent and share >= TEMPLATE_SHARE:
                best = ("exact" if same else "reparameterised", share, sum(len(places) for _, places in runs), runs[0][0])

        for offset, places in sorted(diagonals.items()):
            consider([(offset, sorted(places))])
        if len(diagonals) > 1 and not (best and best[1] == 1):
            for chain in _chains(diagonals, EXACT_SHARE * windows):
                consider(chain)
        return best


def _chains(diagonals: dict[int, set[int]], least: float):
    """Chains of at least ``least`` windows over several diagonals, the longest first: runs of (offset, places).

    Both the places and the document's positions grow along a chain. For each run of neighbouring
    places the longest chain that ends with it is built from the runs before it.
    """
    runs = []  # first and last place, offset
    for offset, places in diagonals.items():
        first = last = None
        for j in sorted(places):
            if first is None or j > last + 1:
                if first is not None:
                    runs.append((first, last, offset))
                first = j
            last = j
        runs.append((first, last, offset))
    runs.sort()
    near: dict[int, list[int]] = defaultdict(list)  # runs so far, by offset
    total, before, begin = [], [], []
    for n, (first, last, offset) in enumerate(runs):
        top, link, at = last - first + 1, -1, first
        for o in range(offset - SHIFT, offset + SHIFT + 1):
            for m in near.get(o, ()):
                start = max(first, runs[m][1] + 1, runs[m][1] + o + 1 - offset)
                if start <= last and total[m] + last - start + 1 > top:
                    top, link, at = total[m] + last - start + 1, m, start
        near[offset].append(n)
        total.append(top)
        before.append(link)
        begin.append(at)
    for n in sorted((n for n in range(len(runs)) if total[n] >= least and before[n] >= 0), key=lambda n: -total[n]):
        chain = []
        while n >= 0:
            chain.append((runs[n][2], list(range(begin[n], runs[n][1] + 1))))
            n = before[n]
        if len({offset for offset, _ in chain}) > 1:
            yield chain[::-1]


RESULT = "doc_id long, item_id long, kind string, coverage double, n_windows long, first_token long"


def _indexes(benchmark: DataFrame):
    """Indexes of the benchmark's blocks; each is of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield Index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and benchmark item that it holds."""
    out = None
    for index in _indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches, shared=shared):
            pieces = _Pieces()
            for b in batches:
                ids, found, at = b.column("doc_id").to_pylist(), [], 0
                for texts in text_slices(b.column("text"), CHUNK):
                    found += [(ids[at + d], *rest) for d, *rest in shared.value.search(texts, pieces)]
                    at += len(texts)
                columns = list(zip(*found)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in RESULT.split(", ")])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(rows), RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(docs: DataFrame, index: Index):
    """A column function: whether a text holds no item of ``index``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # a block of at most BLOCK_BYTES of item text

    def free(columns):
        pieces = _Pieces()
        for column in columns:
            out, at = np.ones(len(column), bool), 0
            for texts in text_slices(column, CHUNK):
                out[[at + f[0] for f in shared.value.search(texts, pieces)]] = False
                at += len(texts)
            yield pa.array(out)

    @F.arrow_udf("boolean")
    def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(free)(columns)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns unchanged; only the texts go to Python."""
    for index in _indexes(benchmark):
        docs = docs.where(_clean(docs, index)("text"))
    return docs
