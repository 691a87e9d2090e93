import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import components, jaccard_join, suffix_dedup


def brute_repeats(rows):
    """By distinct (id, text), in order of id and then of the text's crc."""
    import zlib

    seen, out = set(), {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()))):
        data = t.encode()
        gone = bytearray(len(data))
        for q in range(len(data) - 99):
            s = hashlib.blake2b(data[q : q + 100], digest_size=12).digest()
            if s in seen:
                gone[q : q + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d, t] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_as_brute_force(spark, awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    want = brute_repeats(rows)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(awkward).collect())
    assert got == Counter((d, *want[d, t or ""]) for d, t in rows)


def test_repeats_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    by_id = {d: v for (d, _), v in want.items()}
    for r in suffix_dedup.remove_repeats(docs.repartition(5)).collect():
        assert tuple(r)[1:] == by_id[r["doc_id"]]


def test_no_rows(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_levels_grow_geometrically():
    family = suffix_dedup.Family()
    for i in range(32):
        s = suffix_dedup.Suffixes(np.arange(i, 3200, 32), np.zeros(100), np.zeros(100), np.zeros(100), np.arange(100), np.ones(100))
        assert family.add(suffix_dedup.settle(s)[0]) is not None
        assert all(len(a) > 2 * len(b) for a, b in zip(family.levels, family.levels[1:]))
    assert len(family.close()[0]) == 3200


def test_long_texts_are_cut_with_overlap():
    text = bytes(np.random.default_rng(1).integers(97, 122, 5000, dtype=np.uint8))
    whole = suffix_dedup.Suffixes.concat([suffix_dedup.suffix_array(*suffix_dedup._arrays(g)[:5]) for g in suffix_dedup._batches([(1, text)])])
    cut = suffix_dedup.Suffixes.concat([suffix_dedup.suffix_array(*suffix_dedup._arrays(g)[:5]) for g in suffix_dedup._batches([(1, text)], 700)])
    assert whole.n.sum() == cut.n.sum() == 4901


def brute_components(rows):
    import re

    sets = []
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    found = components.UnionFind(len(sets))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                found.join(i, j)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[found.find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [sets[i][0] for i in members if sets[i][0] is not None]
        out += [(sets[i][0], len(sets[i][1]), min(ids) if ids else None) for i in members]
    return Counter(out)


def test_components_as_brute_force(spark, awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert Counter(map(tuple, jaccard_join.jaccard_components(awkward).collect())) == brute_components(rows)


def test_short_sets(spark, no_docs):
    import random

    from .conftest import docs_of

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(300)]
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, rows)).collect())) == brute_components(rows)


def test_one_of_each_group_stays(spark, awkward):
    kept = jaccard_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    rows = kept.collect()
    ids = sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)
    assert {0, 3, 4, 5, 6, 8, 9, 10, 11} <= set(ids) and not {1, 2, 7} & set(ids) and ids.count(8) == 1
    assert len(ids) == len(rows)  # the row without an id is a copy of row 0


def test_no_text_is_lost(spark):
    from .conftest import docs_of

    texts = [f"{w} is the first of many words here" for w in ("alpha", "beta", "gamma", "delta", "epsilon")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[0]), (7, None), (7, None), (8, " "), (None, texts[1])]
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in jaccard_join.keep_one(docs_of(spark, rows)).collect())
    assert kept == sorted([("6", texts[0]), ("None", texts[1]), ("None", texts[2]), ("5", texts[3]), ("5", texts[4]), ("7", "None"), ("7", "None"), ("8", " ")])


def test_near_copies_without_ids(spark):
    from .conftest import docs_of, prose
    import random

    rng = random.Random(8)
    base = prose(rng, 100).split()
    rows = [(None, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in (3, 50, 97)] + [(None, " ".join(base)), (4, prose(rng, 80))]
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, rows)).collect())) == brute_components(rows)
    assert jaccard_join.keep_one(docs_of(spark, rows)).count() == 2


def test_any_boundary_gives_the_same(spark, monkeypatch):
    import random

    from .conftest import docs_of

    assert jaccard_join.boundary({4: 100}, 500.0) > jaccard_join.boundary({n: 100 for n in range(1, 25)}, 0.5)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 16)))) for i in range(120)]
    for light in (1, 5, 12):
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_, light=light: light)
        assert Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, rows)).collect())) == brute_components(rows)


def test_a_shared_passage_brings_no_texts_together(spark, monkeypatch):
    import random

    from .conftest import docs_of

    # The bound holds lists short at any size of the corpus, and the number of ranked shingles bounded.
    many = {k: 1 << max(0, 24 - k // 8) for k in range(8, 200)}
    assert jaccard_join.FREQUENT <= jaccard_join.least_frequent({k: 10 for k in many}) <= jaccard_join.LONG // 8
    assert sum(n for k, n in many.items() if 2 ** (k / 8) >= jaccard_join.least_frequent(many)) <= jaccard_join.RANKED
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    shared = " ".join(word() for _ in range(110))
    rows = [(i, " ".join(word() for _ in range(25)) + f" {shared} " + " ".join(word() for _ in range(25))) for i in range(20)]
    rows.append((20, rows[0][1] + " more"))
    seen = {}
    real = jaccard_join.components
    monkeypatch.setattr(jaccard_join, "components", lambda links, name: (seen.update({name: links.count()}), real(links, name))[1])
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, rows).coalesce(1)).collect())) == brute_components(rows)
    assert seen["jaccard-blocks"] == 1


def test_blocks_apart_from_their_leaders():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[k * 10 :], rng.integers(0, 2**60, k * 10, dtype=np.uint64)))) for k in range(12)]
    found = jaccard_join.link_block(sets, leaders=1)
    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard_join._linked(a, sets[j]):
                assert found.find(i) == found.find(j)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_connected_components(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "LOCAL", limit)
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components.components(chain).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100 and 100 not in got


def test_many_near_copies_give_few_pairs(spark):
    import random
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from .conftest import docs_of

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for _ in range(3):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, 4)])))
    nothing = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int8)))
    dealt = list(jaccard_join._lists(nothing, 1, 4)([pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})]))
    entries = lambda batches, kind: sum(n for b in batches for k, n in zip(b["kind"].to_pylist(), b["n"].to_pylist()) if k == kind)
    # All pairs of 30 in each list would be about 14 for each of its entries.
    assert entries(jaccard_join._scan(1)(dealt), jaccard_join._PAIR) < 4 * entries(dealt, jaccard_join._LISTED)
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, rows)).collect())) == brute_components(rows)


def test_long_lists_and_groups_lose_no_link(spark, monkeypatch):
    import random

    import numpy as np

    from .conftest import docs_of

    size = np.arange(1, 400)
    for span in (1, 2, 5, 11):
        least = jaccard_join.least_shared_within(size, size + span - 1, *(size[:, None] + k for k in (0, span - 1)))
        for a in range(span):
            for b in range(span):
                assert (least <= jaccard_join.least_shared(size + a, size[:, None] + b)).all()
    rng = random.Random(10)
    base = [f"w{i}" for i in range(70)]
    rows = [(i, " ".join(base[rng.randint(0, 9) : rng.randint(40, 70)])) for i in range(60)]
    for longest in (2, 256):  # chains, pairs
        monkeypatch.setattr(jaccard_join, "LONG", longest)
        assert Counter(map(tuple, jaccard_join.jaccard_components(docs_of(spark, rows).coalesce(1)).collect())) == brute_components(rows)


def test_linked_sets_share_enough_listed_shingles():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(8, 400))
        a = rng.integers(0, 2**62, n, dtype=np.uint64)
        keep = int(rng.integers(int(0.75 * n), n + 1))
        b = np.concatenate((a[:keep], rng.integers(0, 2**62, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)))
        a, b = np.unique(a), np.unique(b)
        if jaccard_join._linked(a, b):
            shared = len(np.intersect1d(a[: jaccard_join.prefix(len(a))], b[: jaccard_join.prefix(len(b))]))
            assert shared >= jaccard_join.least_shared(np.array([len(a)]), np.array([len(b)]))[0]


def test_repeats_without_ids(spark):
    import random

    from .conftest import docs_of, prose

    rng = random.Random(9)
    shared = prose(rng, 60)
    rows = [(None, prose(rng, rng.randint(1, 30)) + shared[rng.randint(0, 100) :] + prose(rng, 20)) for _ in range(12)] + [(3, shared), (None, shared), (None, shared)]
    want = brute_repeats(rows)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect())
    assert got == Counter((d, *want[d, t]) for d, t in rows)
