"""Packing of token streams into sequences by Karmarkar-Karp multiway differencing.

Every document becomes its token ids and an end id. A partition of the input is packed on its
own, in groups of bounded size, so that no row is shuffled. In a group, full sequences are cut
from long documents first; of the rest a tail of less than about one sequence goes into
sequences whose length is a power of two (these are not padded); what remains is cut into
pieces that differencing deals over windows: partial partitions are kept in a heap by spread,
the two widest are merged with opposing imbalances until one is left, which gives windows of
nearly equal length. Whenever a window exceeds the capacity, the window count rises by one.

Null and empty texts have only the end id; very long texts are cut over many sequences. Repeated
rows are packed each, null ids are kept, extra columns are ignored; an empty table gives no
pieces. Sequence ids are unique over the table: partition number, then a running number; a
recomputed task gives the same.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import crc32, releasing, strings

CAPACITY, END = 4096, 2
#: Pieces of a group; longest piece; tokens that each window leaves free.
GROUP_PIECES, PIECE, SLACK = 2048, 512, 8
#: Bound of each worker's memo of token ids (speed and memory only); bytes encoded at once.
MEMO, CHUNK = 300_000, 1 << 20

# Texts with other characters than these are left whole to the tokenizer.
UNUSUAL = re.compile("[^\x00-\x1b\x20-ɏ]")
# Whole runs of ASCII marks, '_' being one, but the apostrophe, which the tokenizer may join to letters. A run next to any other mark is left to the tokenizer.
MARKS = re.compile(r"(?<![^\w\s])(?<!_)[!-&(-/:-@\[-`{-~]+(?![^\w\s])(?!_)")
# Without others that count as marks, every run is whole: those of usual texts, control characters among them, and what lower-casing splits off.
RUNS = re.compile(r"[!-&(-/:-@\[-^`{-~]+")
OTHERS = re.compile("[" + "".join(re.escape(chr(c)) for c in (*range(0x250), *range(0x300, 0x370)) if re.match(r"[^\w\s]|_", chr(c)) and not RUNS.match(chr(c))) + "]")
# Texts of these bytes only are usual and without others: ASCII and U+00C0 to U+023F, letters but for these; İ splits when lower-cased.
PLAIN = bytes(b for b in range(256) if (not UNUSUAL.match(chr(b)) and not OTHERS.match(chr(b)) if b < 0x80 else b < 0xC0 or 0xC3 <= b <= 0xC8))
NOT_PLAIN = "×÷İ"
# Kinds of UTF-8 bytes in usual texts without others: white space, marks of runs, parts of words.
SPACE, MARK, WORD = range(3)
KINDS = np.array([SPACE if b < 0x80 and chr(b).isspace() else MARK if RUNS.match(chr(b)) else WORD for b in range(256)], np.uint8)
# The characters by which the vocabulary writes bytes: visible ones of Latin-1 stand for themselves, the others are numbered from U+0100.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
BYTE_CHARS = {b: 0x100 + n for n, b in enumerate(_HIDDEN)}


class Encoder:
    """Token ids of texts, equal to the tokenizer's own.

    The tokenizer drops white space and treats the words between, and runs of marks, as
    independent, so their ids can be kept; words that are new in a chunk go to its model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _prepare(self, text: str) -> tuple[bytes, bool] | None:
        """The text lower-cased in UTF-8, and whether its marks are all of whole runs (else they are cut off already); None if it is for the tokenizer."""
        if "<|" in text and any(s in text for s in self.special):
            return None
        data = text.encode()
        if not data.translate(None, PLAIN) and (len(data) == len(text) or not any(c in text for c in NOT_PLAIN)):
            return text.lower().encode(), True
        if UNUSUAL.search(text):
            return None
        text = text.lower()
        if OTHERS.search(text):
            return " ".join(MARKS.sub(r" \g<0> ", text).split()).encode(), False
        return " ".join(text.split()).encode(), True

    @staticmethod
    def _tokens(prepared: list[tuple[bytes, bool]]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Words and runs of marks of texts: their numbers in order, the different ones, and how many there are up to the end of each text."""
        ends = np.cumsum([len(data) + 1 for data, _ in prepared], dtype=np.int64)
        chars = np.frombuffer(b"\n".join([*(data for data, _ in prepared), b""]), np.uint8)
        kinds = KINDS[chars]
        for (data, runs), end in zip(prepared, ends.tolist()):
            if not runs:
                part = kinds[end - 1 - len(data) : end]
                part[part == MARK] = WORD
        inside = kinds != SPACE
        starts = (np.diff(kinds, prepend=np.uint8(SPACE)) != 0) & inside
        chars = chars[inside]
        offsets = np.append(np.flatnonzero(starts[inside]), len(chars)).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(chars)).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(np.flatnonzero(starts), ends)

    def _ids(self, tokens: list[str]) -> list[bytes]:
        """The ids of different words and runs of marks, 16 bits each."""
        memo, tokenize = self.memo, self.model.tokenize
        out = list(map(memo.get, tokens))
        new = [i for i, x in enumerate(out) if x is None]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            memo.update((t, x) for t, x in zip(tokens, out) if x is not None)
        for i in new:
            t = tokens[i]
            if t.isalpha() or MARKS.fullmatch(t):
                # One word to the tokenizer, which normalising and cutting leave as it is.
                ids = [x.id for x in tokenize(t if t.isascii() else t.encode().decode("latin-1").translate(BYTE_CHARS))]
            else:
                ids = self._exact(t).tolist()
            out[i] = memo[t] = array("H", ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; works on about ``CHUNK`` characters at a time."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            prepared = [self._prepare(t) for t in texts[i:j]]
            numbers, tokens, stops = self._tokens([p for p in prepared if p])
            known = self._ids(tokens)
            lengths = np.fromiter(map(len, known), np.int64, len(known)) // 2
            # Of the tokens in order: how many ids each has, where these end, and how far from there they lie in the known ones.
            counts = lengths[numbers]
            ends = np.cumsum(counts)
            shifts = np.cumsum(lengths)[numbers] - ends
            ids = np.frombuffer(b"".join(known), np.uint16).astype(np.uint32)[np.arange(counts.sum()) + np.repeat(shifts, counts)]
            parts = iter(np.split(ids, np.append(0, ends)[stops]))
            for text, p in zip(texts[i:j], prepared):
                yield next(parts) if p else self._exact(text)
            i = j


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items over ``k`` windows by multiway differencing; item numbers of each window."""
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # of merged nodes; items are the first n nodes
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, av, an = heapq.heappop(heap)
        _, _, bv, bn = heapq.heappop(heap)
        if len(av) + len(bv) <= k:
            v, nodes = np.concatenate((av, bv)), np.concatenate((an, bn))
        else:
            v, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
            v[: len(av)], nodes[: len(av)] = av, an
            start = k - len(bv)
            v[start:] += bv[::-1]
            both = np.flatnonzero((nodes[start:] >= 0) & (bn[::-1] >= 0)) + start
            other = np.full(k, -1, np.int64)
            other[start:] = bn[::-1]
            a, b = nodes[both].tolist(), other[both].tolist()
            nodes = np.where(nodes >= 0, nodes, other)
            nodes[both] = np.arange(len(left), len(left) + len(both))
            left += a
            right += b
            v -= v.min()
        sort = np.argsort(-v, kind="stable")
        v, nodes = v[sort], nodes[sort]
        heapq.heappush(heap, (-int(v[0] - (v[-1] if len(v) == k else 0)), order, v, nodes))
        order += 1
    windows = []
    for root in heap[0][3].tolist() if heap else []:
        items, stack = [], [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x], right[x])
        windows.append(sorted(items))
    return windows


def _cut(spans: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """Spans (document, start, length) in even pieces of at most ``most`` tokens."""
    out = []
    for d, start, length in spans:
        parts = -(-length // most)
        for p in range(parts):
            a, b = length * p // parts, length * (p + 1) // parts
            out.append((d, start + a, b - a))
    return out


def pack(spans: list[tuple[int, int, int]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of spans (document, start, length), holding every token once."""
    full, rest = [], []
    for d, start, length in spans:
        whole = length // capacity
        full += [[(d, start + i * capacity, capacity)] for i in range(whole)]
        if length % capacity:
            rest.append((d, start + whole * capacity, length % capacity))
    total = sum(x[2] for x in rest)
    k = total // (capacity - SLACK)
    tail = total - k * (capacity - SLACK)
    tails = []
    while tail:  # sequences of a power of two need no padding
        size = min(capacity, 1 << (tail.bit_length() - 1))
        tail -= size
        sequence = []
        while size:
            d, start, length = rest.pop()
            take = min(size, length)
            if take < length:
                rest.append((d, start, length - take))
            sequence.append((d, start + length - take, take))
            size -= take
        tails.append(sequence)
    if not k:
        return full + tails
    pieces = _cut(rest, PIECE)
    while True:
        windows = differencing([x[2] for x in pieces], k)
        if max(sum(pieces[i][2] for i in w) for w in windows) <= capacity:
            return full + [[pieces[i] for i in w] for w in windows if w] + tails
        k += 1


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """One row for each piece of every document of ``docs`` (doc_id, text)."""

    def rows(batches):
        encoder = Encoder(tokenizer_path)
        first = TaskContext.get().partitionId() << 33
        number = 0
        ids: list[np.ndarray] = []
        names: list = []
        pieces = 0

        def emit():
            nonlocal number, ids, names, pieces
            out = []
            for sequence in pack([(i, 0, len(a)) for i, a in enumerate(ids)], capacity):
                offset = 0
                for d, start, length in sequence:
                    out.append((names[d], start, length, crc32(ids[d][start : start + length].astype("<u4").tobytes()), len(ids[d]), first + number, offset))
                    offset += length
                number += 1
            ids, names, pieces = [], [], 0
            columns = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in COLUMNS.split(", ")])

        end = np.array([end_id], np.uint32)
        for b in batches:
            for doc_id, a in zip(b.column("doc_id").to_pylist(), encoder.encode(strings(b.column("text")))):
                names.append(doc_id)
                ids.append(np.concatenate((a, end)))
                pieces += -(-len(ids[-1]) // PIECE)
                if pieces >= GROUP_PIECES:
                    yield emit()
        if ids:
            yield emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(rows), COLUMNS)
