"""Toxicity scores: boosted trees over dense text features, with isotonic calibration.

A lexicon of whole words and word starts is learned from labelled texts, then densities of
lexicon hits, their nearness to second-person words, capitals, punctuation and obfuscation
rates form the dense features of a gradient-boosted tree ensemble. Scores out of fold fit an
isotonic calibration.

Only fitting uses a bounded sample (``TRAIN_ROWS`` labelled rows, those with the smallest id
hash); every row is scored on its whole text. Null and empty texts get the score of a text
without words; very long texts are scored whole, one at a time. Repeated label rows of an id
count once (the larger label); null labels are ignored; without labels of both kinds every score
is 0.0. Repeated documents are each scored; equal texts get equal scores. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from ._util import crc_bucket, releasing, strings, text_slices, written

#: Labelled rows used for fitting, at most; lexicon entries kept, at most; cross-fitting folds.
TRAIN_ROWS, ENTRIES, FOLDS = 24_000, 20_000, 4
#: Lengths of word starts that the lexicon may hold besides whole words.
STARTS = (4, 5, 6)
#: A hit is an entry with at least this log-odds.
STRONG = 1.5
#: Bound of each worker's memo of tokens (speed and memory only).
MEMO = 150_000

# Second-person words of the corpus languages.
SECOND = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer Sie Ihnen usted ustedes tú ti tuyo vosotros".lower().split()
)
# Look-alike characters.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")

WORD = re.compile(r"[^\W\d_]+")
EDGE = ".,;:!?\"'()[]|-*#$%&"
MASKED = re.compile(r"[^\W_][0-9@$*!|#]+[^\W_]")
SPELT = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_* ]){3,}[^\W\d_](?!\w)")
LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
PUNCT_RUN = re.compile(r"[!?]{2,}")
CAPITAL = re.compile(r"[A-Z\u00c0-\u00d6\u00d8-\u00de]")


def keys_of(word: str) -> list[str]:
    """The whole word (marked) and its starts."""
    return ["=" + word, *(word[:k] for k in STARTS if len(word) >= k)]


class _Weights(dict):
    """word -> largest log-odds of its entries, filled when first asked for."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: str) -> float:
        get = self.entries.get
        value = max(get(k, 0.0) for k in keys_of(word))
        if len(self) >= MEMO:
            self.clear()
        self[word] = value
        return value


class Lexicon(dict):
    """What a token between spaces holds, found when first asked for:
    words, letters, largest log-odds, second person, masked, hit after unmasking, long run, digits, single letter."""

    def __init__(self, entries: dict[str, float]):
        super().__init__()
        self.entries, self.weights, self.plain = entries, _Weights(entries), {}

    def __missing__(self, token: str) -> tuple:
        core = token if token.isalpha() else token.strip(EDGE)
        if len(self) >= MEMO:
            self.clear()
        if core is not token and core in self and core.isalpha():
            found = self[core]
        elif core.isalpha():
            get, weight = self.entries.get, 0.0
            for key in ("=" + core, *[core[:k] for k in STARTS]):
                value = get(key)
                if value is not None and value > weight:
                    weight = value
            plain = (1, len(core), weight, core in SECOND, False, False, LONG_RUN.search(core) is not None, 0, len(core) == 1)
            found = self.plain.setdefault(plain, plain)  # few are different, so they are shared
        else:
            found = self._mixed(token)
        self[token] = found
        return found

    def _mixed(self, token: str) -> tuple:
        weights = self.weights
        words = WORD.findall(token)
        weight = max((weights[w] for w in words), default=0.0)
        masked = bool(words) and bool(MASKED.search(token))
        spelt = len(words) > 3 and all(len(w) == 1 for w in words)
        shown = "".join(words) if spelt else token.translate(LOOKALIKE) if masked else ""
        hidden = weight < STRONG and any(weights[w] >= STRONG for w in WORD.findall(shown))
        return (
            len(words), sum(map(len, words)), weight, any(w in SECOND for w in words), masked or spelt, hidden,
            bool(LONG_RUN.search(token)), sum(map(str.isdigit, token)), len(words) == 1 and len(words[0]) == 1,
        )


WIDTH = 24


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text."""
    out = [0.0] * WIDTH
    lower = text.lower()
    tokens = lower.split()
    if not tokens:
        return out
    chars = len(text)
    words = letters = found = second = masked = hidden = runs = digits = single = 0
    mass = strong = 0.0
    tops: list[float] = []
    counts = Counter(tokens)
    for token, c in counts.items():
        n, size, weight, you, mask, hid, run, dig, one = lexicon[token]
        words += n * c
        letters += size * c
        if weight > 0:
            mass += weight * c
            if weight >= STRONG:
                found += c
                strong += weight * c
                tops.append(weight)
        if you:
            second += c
        if mask:
            masked += c
            hidden += hid * c
        if run:
            runs += c
        digits += dig * c
        if one:
            single += c
    n = max(1, words)
    top = sorted(tops, reverse=True)[:3] + [0.0] * 3
    out[0], out[1], out[2] = found / n, math.log1p(found), len(tops)
    out[3], out[4], out[5] = top[0], top[1], top[2]
    out[6], out[7], out[8] = mass / n, strong, second / n
    if found and second:
        spots = np.array([i for i, t in enumerate(tokens) if lexicon[t][3]])
        hit = np.array([i for i, t in enumerate(tokens) if lexicon[t][2] >= STRONG])
        k = np.searchsorted(spots, hit)
        gap = np.minimum(np.abs(hit - spots[np.maximum(k - 1, 0)]), np.abs(hit - spots[np.minimum(k, len(spots) - 1)]))
        out[9], out[10] = float((gap <= 5).sum()) / n, 1.0 / (1 + float(gap.min()))
    out[11], out[12], out[13] = math.log1p(words), len(counts) / len(tokens), letters / n
    out[14] = len(CAPITAL.findall(text)) / chars
    out[15], out[16] = text.count("!") * 100.0 / chars, text.count("?") * 100.0 / chars
    out[17] = 100.0 * len(PUNCT_RUN.findall(text)) / chars if out[15] or out[16] else 0.0
    if single >= 4:
        weights = lexicon.weights
        spelt = SPELT.findall(lower)
        masked += len(spelt)
        hidden += sum(1 for m in spelt if weights["".join(WORD.findall(m))] >= STRONG)
    out[18], out[19], out[20] = masked / n, math.log1p(hidden), single / n
    out[21], out[22] = runs / n, 100.0 * digits / chars
    out[23] = max(counts.values()) / len(tokens)
    return out


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, toxic, fold and text of the bounded sample of labelled training rows."""
    train = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where("toxic in (0, 1) and doc_id is not null")
        .where(crc_bucket("doc_id", 3) != 1)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("_h", F.xxhash64("doc_id"))
        .orderBy("_h", "doc_id").limit(rows)
        .select("doc_id", "toxic", F.pmod("_h", F.lit(FOLDS)).cast("int").alias("fold"))
    )
    # Broadcast: at most `rows` ids and two small integers.
    return docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("doc_id", "toxic", "fold", F.coalesce("text", F.lit("")).alias("text"))


def _count_keys(batches):
    for b in batches:
        seen: Counter = Counter()
        for toxic, fold, text in zip(b.column("toxic").to_pylist(), b.column("fold").to_pylist(), strings(b.column("text"))):
            keys = {k for w in set(WORD.findall(text.lower())) for k in keys_of(w)}
            seen.update((k, fold, toxic) for k in keys)
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.int32()), pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())],
            names=["key", "fold", "toxic", "n"],
        )


def _log_odds(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Smoothed log-odds, 0 where the support is thin."""
    if pos < 3:
        return 0.0
    return max(0.0, math.log((pos / (n_pos + 2)) / ((neg + 1.0) / (n_neg + 2))))


class ToxicityModel:
    """Lexicon, trees and calibration; picklable and of bounded size."""

    def __init__(self, entries: dict[str, float], trees: gbdt.Boosted | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.entries, self.trees, self.knots = entries, trees, knots

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a small share of the raw probability keeps the order inside plateaus."""
        if self.trees is None:
            return np.zeros(len(x))
        raw = self.trees.raw(x)
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 * gbdt.sigmoid(raw), 0.0, 1.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on at most ``rows`` labelled rows outside the held-out fold (crc32(doc_id) mod 3 = 1)."""
    sample = written(_sample(docs, labels, rows), "toxicity-sample")
    totals = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n_by = np.array([[totals.get((f, t), 0) for t in (0, 1)] for f in range(FOLDS)], float)
    if not n_by[:, 1].sum() or not n_by[:, 0].sum():
        return ToxicityModel({}, None, None)
    per = sample.mapInArrow(releasing(_count_keys), "key string, fold int, toxic int, n long").groupBy("key").agg(
        *(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"c{f}{t}") for f in range(FOLDS) for t in (0, 1))
    )
    pos = sum(F.col(f"c{f}1") for f in range(FOLDS))
    neg = sum(F.col(f"c{f}0") for f in range(FOLDS))
    odds = (pos / float(n_by[:, 1].sum() + 2)) / ((neg + 1.0) / float(n_by[:, 0].sum() + 2))
    kept = per.where((pos >= 3) & (odds > math.e)).orderBy((F.log(odds) * F.sqrt(pos.cast("double"))).desc(), "key").limit(ENTRIES).collect()
    counts = {r["key"]: np.array([[r[f"c{f}{t}"] for t in (0, 1)] for f in range(FOLDS)], float) for r in kept}

    def entries(without: int | None) -> dict[str, float]:
        use = [f for f in range(FOLDS) if f != without]
        n_neg, n_pos = n_by[use].sum(0)
        return {k: v for k, c in counts.items() if (v := _log_odds(c[use, 1].sum(), c[use, 0].sum(), n_pos, n_neg)) > 0}

    by_fold = [entries(f) for f in range(FOLDS)]

    def rows_of(batches):
        lexica = [Lexicon(e) for e in by_fold]
        for b in batches:
            fold = b.column("fold").to_pylist()
            x = [features(t, lexica[f]) for t, f in zip(strings(b.column("text")), fold)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("toxic"), b.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    table = sample.mapInArrow(releasing(rows_of), "doc_id long, toxic int, fold int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(table["x"].to_pylist(), float).reshape(-1, WIDTH)
    y = table["toxic"].to_numpy().astype(float)
    fold = table["fold"].to_numpy()
    out = np.zeros(len(y))
    for f in range(FOLDS):
        inside = fold == f
        if inside.any():
            out[inside] = gbdt.fit(x[~inside], y[~inside]).raw(x[inside])
    return ToxicityModel(entries(None), gbdt.fit(x, y), gbdt.isotonic(out, y))


def _scorer(docs: DataFrame, model: ToxicityModel):
    """A column function from texts to scores: only the texts go to Python, 8 bytes come back for each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ENTRIES words and a few trees

    def scores(columns):
        m = shared.value
        lexicon = Lexicon(m.entries)
        for column in columns:
            x = [features(t, lexicon) for texts in text_slices(column) for t in texts]
            yield pa.array(m.score(np.array(x, float).reshape(-1, WIDTH)), pa.float64())

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(scores)(columns)

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; nothing but the text is read for a score."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_bucket("doc_id", 3) == 1).alias("held_out"), _scorer(docs, model)("text").alias("score"))
    return given.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with their columns unchanged."""
    return docs.where(_scorer(docs, model)("text") < threshold)
