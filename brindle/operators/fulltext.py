"""BM25 full-text search as DataFrame plans over postings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
# Endings that the English tokenizer strips.
ENDINGS = ("ing", "edly", "ed", "ly", "ies", "es", "s")


def tokens(text: Column, english: bool = False) -> Column:
    """Letter and digit runs of 2 to 100 characters in lower case; ``english`` strips one ending."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.char_length(w).between(2, 100))
    return F.transform(words, lambda w: F.regexp_replace(w, rf"^(.{{3,}}?)({'|'.join(ENDINGS)})$", "$1")) if english else words


def ngrams(text: Column, least: int = 2, most: int = 3) -> Column:
    """All letter n-grams of the words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cut = lambda w, n: F.when(F.char_length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(words, lambda w: F.concat(*(cut(w, n) for n in range(least, most + 1)))))


def postings(docs: DataFrame, id_column: str = "doc_id", text: str = "text", english: bool = False) -> DataFrame:
    """term, doc, tf, positions and the document's length."""
    words = docs.select(F.col(id_column).alias("doc"), tokens(F.col(text), english).alias("w")).withColumn("length", F.size("w"))
    placed = words.select("doc", "length", F.posexplode("w").alias("position", "term"))
    return placed.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.sort_array(F.collect_list("position")).alias("positions"))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents and mean length."""
    return docs.select(F.size(tokens(F.col(text))).alias("l")).agg(F.count("*").cast("double").alias("n"), F.avg("l").alias("mean"))


def bm25(docs: DataFrame, query: list[str], id_column: str = "doc_id", text: str = "text", boosts: dict[str, float] | None = None) -> DataFrame:
    """doc and score of every document that holds a term of the query; terms of negative idf score 0.

    One pass counts the query's terms in each document; no text is shuffled. A text is cut into
    words once: they are bound to a variable, and the counts come out of a generator, below which
    the optimizer does not push the condition on the score.
    """
    terms = list(dict.fromkeys(query))
    count = lambda w: F.struct(F.size(w).alias("length"), *[F.size(F.filter(w, _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    counted = docs.select(F.col(id_column).alias("doc"), F.explode(F.transform(F.array(tokens(F.col(text))), count)).alias("_c")).select("doc", "_c.*")
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = F.greatest(F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(0.0))
        tf = F.col(f"tf{i}")
        score = score + (boosts or {}).get(t, 1.0) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    whole = stats.select(F.struct("*")).scalar()
    known = counted.withColumn("_s", whole).select("*", "_s.*")
    return known.select("doc", score.alias("score")).where("score > 0")


def _is(term: str):
    return lambda w: w == F.lit(term)


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc("doc")).limit(k)


def phrase(docs: DataFrame, words: list[str], slop: int = 0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of the documents that hold the words in order, with at most ``slop`` words between neighbours."""
    gap = r"(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+){0,%d}[^\p{L}\p{N}]+" % slop if slop else r"[^\p{L}\p{N}]+"
    pattern = r"(?<![\p{L}\p{N}])" + gap.join(map(re.escape, words)) + r"(?![\p{L}\p{N}])"
    return docs.where(F.lower(F.col(text)).rlike(pattern)).select(F.col(id_column).alias("doc"))


def boolean(docs: DataFrame, must: list[str] = (), must_not: list[str] = (), should: list[str] = (), least: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and score 1 a matching clause."""
    w = tokens(F.col(text))
    has = lambda t: F.array_contains(w, t)
    kept = docs
    for t in must:
        kept = kept.where(has(t))
    for t in must_not:
        kept = kept.where(~has(t))
    hits = sum((has(t).cast("int") for t in should), F.lit(0))
    if should:
        kept = kept.where(hits >= least)
    return kept.select(F.col(id_column).alias("doc"), (hits + len(must)).cast("double").alias("score"))


def fuzzy(docs: DataFrame, term: str, distance: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Best 1 - distance / length over the words within ``distance`` of ``term``."""
    near = F.filter(F.array_distinct(tokens(F.col(text))), lambda w: (F.abs(F.char_length(w) - len(term)) <= distance) & (F.levenshtein(w, F.lit(term)) <= distance))
    score = F.array_max(F.transform(near, lambda w: 1 - F.levenshtein(w, F.lit(term)) / F.greatest(F.char_length(w), F.lit(len(term)))))
    return docs.select(F.col(id_column).alias("doc"), score.alias("score")).where("score is not null")


def wildcard(docs: DataFrame, pattern: str, column: str, id_column: str = "doc_id") -> DataFrame:
    """* for any run, ? for one character, over the whole field."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return docs.where(F.col(column).rlike(f"(?s)^{regex}$")).select(F.col(id_column).alias("doc"))


def disjunction_max(parts: list[DataFrame], tie: float = 0.0) -> DataFrame:
    """Largest score plus ``tie`` times the second."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    best = union.groupBy("doc").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    return best.select("doc", (F.get("s", F.lit(0)) + tie * F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))).alias("score"))


def constant(found: DataFrame, score: float) -> DataFrame:
    return found.select("doc", F.lit(score).alias("score"))


def highlight(text: Column, terms: list[str], pre: str = "<em>", post: str = "</em>") -> Column:
    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + r")(?![\p{L}\p{N}])"
    return F.regexp_replace(text, pattern, f"{pre}$1{post}")


def parse_query(text: str) -> dict[str, list]:
    """A query string: +must, -must_not, "phrase", OR, NOT, term^boost, term~n, field:term; boosts as pairs (term, boost)."""
    out: dict[str, list] = {"must": [], "must_not": [], "should": [], "phrases": [], "fuzzy": [], "fields": [], "boosts": []}
    to = "should"
    for m in re.finditer(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|(\S+))', text):
        sign, field, quoted, word = m.groups()
        if word in ("AND", "OR", "NOT"):
            to = {"AND": "must", "OR": "should", "NOT": "must_not"}[word]
            continue
        kind = {"+": "must", "-": "must_not"}.get(sign, to)
        to = "should"
        if quoted is not None:
            out["phrases"].append(quoted.lower().split())
        elif f := re.fullmatch(r"(.+)~(\d*)", word):
            out["fuzzy"].append((f[1].lower(), int(f[2] or 2)))
        elif field:
            out["fields"].append((field, word))
        else:
            term, _, boost = word.lower().partition("^")
            out[kind].append(term)
            if boost:
                out["boosts"].append((term, float(boost)))
    return out


def fuse_rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of top lists (doc, score)."""
    union = None
    for one in lists:
        ranked = one.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("doc")))).select("doc", (1.0 / (k + F.col("_r"))).alias("score"))
        union = ranked if union is None else union.unionByName(ranked)
    return union.groupBy("doc").agg(F.sum("score").alias("score"))


def fuse_weighted(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """Scores over the list's top score, weighted and summed."""
    union = None
    for one, weight in lists:
        top_score = one.agg(F.max("score")).scalar()
        scaled = one.select("doc", (weight * F.col("score") / top_score).alias("score"))
        union = scaled if union is None else union.unionByName(scaled)
    return union.groupBy("doc").agg(F.sum("score").alias("score"))


# --- further queries ------------------------------------------------------------------------------


def _found(docs: DataFrame, condition: Column, id_column: str) -> DataFrame:
    return docs.where(condition).select(F.col(id_column).alias("doc"), F.lit(1.0).alias("score"))


def match_all(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Every document, with score 1."""
    return _found(docs, F.lit(True), id_column)


def match_none(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return _found(docs, F.lit(False), id_column)


def in_range(docs: DataFrame, column: str, low=None, high=None, with_low: bool = True, with_high: bool = True, id_column: str = "doc_id") -> DataFrame:
    """Documents whose field lies between the bounds; None is no bound."""
    c, condition = F.col(column), F.col(column).isNotNull()
    if low is not None:
        condition = condition & (c >= low if with_low else c > low)
    if high is not None:
        condition = condition & (c <= high if with_high else c < high)
    return _found(docs, condition, id_column)


def exists(docs: DataFrame, column: str, id_column: str = "doc_id") -> DataFrame:
    """Documents that have the field."""
    return _found(docs, F.col(column).isNotNull(), id_column)


def term_set(docs: DataFrame, terms: list[str], least: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold at least ``least`` of the terms."""
    return _found(docs, F.size(F.array_intersect(tokens(F.col(text)), F.array(*map(F.lit, terms)))) >= least, id_column)


def prefix(docs: DataFrame, start: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a word that begins with ``start``."""
    return _found(docs, F.exists(tokens(F.col(text)), lambda w: F.startswith(w, F.lit(start.lower()))), id_column)


def phrase_prefix(docs: DataFrame, words: list[str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold the words in order, the last one at least as the start of a word."""
    pattern = r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(re.escape(w.lower()) for w in words)
    return _found(docs, F.lower(F.col(text)).rlike(pattern), id_column)


def regex(docs: DataFrame, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with a word that the pattern matches as a whole."""
    return _found(docs, F.exists(tokens(F.col(text)), lambda w: w.rlike(f"^(?:{pattern})$")), id_column)


def nested(docs: DataFrame, column: str, condition, id_column: str = "doc_id") -> DataFrame:
    """Documents of whose array field an element meets ``condition``, a function of the element."""
    return _found(docs, F.exists(column, condition), id_column)


def function_score(found: DataFrame, docs: DataFrame, factor: Column, id_column: str = "doc_id") -> DataFrame:
    """The scores of ``found`` times a function of the document's fields."""
    factors = docs.select(F.col(id_column).alias("doc"), factor.cast("double").alias("_f"))
    return found.join(factors, "doc").select("doc", (F.col("score") * F.col("_f")).alias("score"))


def run_query(docs: DataFrame, query: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc and score of the documents that a query string finds.

    Required terms, phrases and fields must hold, excluded terms must not; without any required part
    at least one optional term or near word must. The score is BM25 over required and optional
    terms, each times its boost; a document that has none of them scores 0.
    """
    q = parse_query(query)
    near = lambda w, t, n: F.exists(w, lambda x: (F.abs(F.char_length(x) - len(t)) <= n) & (F.levenshtein(x, F.lit(t)) <= n))

    def holds(w: Column) -> Column:
        out = F.lit(True)
        for t in q["must"]:
            out = out & F.array_contains(w, t)
        for t in q["must_not"]:
            out = out & ~F.array_contains(w, t)
        optional = [F.array_contains(w, t) for t in q["should"]] + [near(w, t, n) for t, n in q["fuzzy"]]
        if optional and not (q["must"] or q["phrases"] or q["fields"]):
            out = out & F.greatest(*optional, F.lit(False))
        return out

    kept = docs
    for field, value in q["fields"]:
        kept = kept.where(F.lower(F.col(field).cast("string")) == value.lower())
    for p in q["phrases"]:
        pattern = r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(map(re.escape, p)) + r"(?![\p{L}\p{N}])"
        kept = kept.where(F.lower(F.col(text)).rlike(pattern))
    ids = kept.where(F.get(F.transform(F.array(tokens(F.col(text))), holds), F.lit(0))).select(F.col(id_column).alias("doc"))
    terms = q["must"] + q["should"]
    if not terms:
        return ids.select("doc", F.lit(0.0).alias("score"))
    return ids.join(bm25(docs, terms, id_column, text, dict(q["boosts"])), "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def match_against(docs: DataFrame, query: str, boolean_mode: bool = False, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """MATCH (text) AGAINST (query): documents of a positive BM25 score, or those that the query string finds in boolean mode."""
    if boolean_mode:
        return run_query(docs, query, id_column, text)
    return bm25(docs, [w for w in re.split(r"[\W_]+", query.lower()) if len(w) > 1], id_column, text)
