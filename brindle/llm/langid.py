"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (1 to 3 letters, words padded by a boundary
mark) of a language in order of frequency; a document goes to the profile with the smallest
out-of-place distance between its own ranking and the profile's.

Profiles may come from a bounded sample (about ``TRAIN_DOCS`` documents a language, chosen by
id hash); every document is ranked on its whole text. Texts that are null, empty or without a
letter give ``und`` and score 0, as does every text where nothing could be learned. Ties between
languages go to the smaller name, ties between n-grams to the smaller code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import crc_bucket, strings

#: Documents for each profile, about; n-grams in a profile.
TRAIN_DOCS, PROFILE = 4_000, 400
_EDGE = 1  # code of the word boundary
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; built once in each worker."""
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text, each packed in 63 bits, and their counts."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    s = np.where(_letters()[cp], cp, _EDGE)
    s = np.concatenate(([_EDGE], s, [_EDGE]))
    s = s[np.concatenate(([True], (s[1:] != _EDGE) | (s[:-1] != _EDGE)))]  # runs of boundaries become one
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = s[s != _EDGE]
    two = (s[:-1] << 21) | s[1:]
    mid = s[1:-1] != _EDGE
    three = ((s[:-2] << 42) | (s[1:-1] << 21) | s[2:])[mid]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranking(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes in order of falling count, then rising code."""
    if len(codes) > 4 * size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= cut
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Language names and, for each, its ranking."""

    def __init__(self, ranked: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(ranked), size
        self.sorted = []
        for name in self.names:
            order = np.argsort(ranked[name])
            self.sorted.append((ranked[name][order], order))

    def predict(self, text: str) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.names:
            return "und", 0.0
        own = ranking(codes, counts, self.size)
        place = np.arange(len(own))
        distance = []
        for known, rank in self.sorted:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            there = known[at] == own
            distance.append(int(np.where(there, np.abs(rank[at] - place), self.size).sum()))
        best = int(np.argmin(distance))
        if len(distance) == 1:
            return self.names[0], 1.0 - distance[0] / (self.size * len(own))
        rest = min(d for i, d in enumerate(distance) if i != best)
        return self.names[best], rest / (rest + distance[best]) if rest else 0.5


def _count(batches):
    for b in batches:
        by: dict[str, list] = {}
        for lang, text in zip(b.column("lang").to_pylist(), strings(b.column("text"))):
            by.setdefault(lang, []).append(grams(text))
        for lang, found in by.items():
            codes, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([f[1] for f in found]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])


def fit_profiles(docs: DataFrame, per_language: int = TRAIN_DOCS, size: int = PROFILE) -> Profiles:
    """Profiles from text and lang of documents outside the held-out fold (crc32(doc_id) mod 4 = 2)."""
    train = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null").where(crc_bucket("doc_id", 4) != 2)
    totals = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Profiles({}, size)
    share = F.create_map(*(F.lit(v) for k, n in totals.items() for v in (k, min(1.0, per_language / n))))
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Top of each salted part first: no task gets all n-grams of a language.
    order = [F.desc("n"), F.asc("code")]
    part = counted.withColumn("_part", F.pmod(F.hash("code"), F.lit(64))).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= size)
    top = part.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("_r") <= size).select("lang", "code", "_r").collect()
    ranked: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["_r"])):
        ranked.setdefault(r["lang"], []).append(r["code"])
    return Profiles({k: np.array(v, np.int64) for k, v in ranked.items()}, size)


def predict_language(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; only the text is read for a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # `size` numbers a language

    def rows(batches):
        p = shared.value
        for b in batches:
            found = [p.predict(t) for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket("doc_id", 4) == 2).alias("held_out"), "text")
    return given.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")
