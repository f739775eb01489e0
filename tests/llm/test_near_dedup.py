import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string"


def sets_of(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent=80):
    sets = [(i, sets_of(t, n)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i, _ in sets}


def corpus(seed, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 3, 25])):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 8))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = copy
            rows.append((i * 7 % 1009, " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy), "en"))
            i += 1
    return rows


def test_sets():
    texts = ["a B a b", "one", None, "", " \t\n", "é\xa0x y"]
    sets = near_dedup.shingle_sets(pa.array(texts), 2)
    assert [len(s) for s in sets] == [len(sets_of(t, 2)) for t in texts] == [2, 1, 0, 0, 0, 1]


def test_estimate_and_recall():
    rng = np.random.default_rng(0)
    errors, missed = [], 0
    for _ in range(300):
        both, one = rng.integers(0, 1 << 64, 320, np.uint64), rng.integers(0, 1 << 64, (2, 40), np.uint64)
        mins = np.array([near_dedup.minima(np.concatenate([both, x])) for x in one])
        a, b = near_dedup.packed(mins)
        slots = sum(bin(int(x) & (15 << s)).count("1") > 0 for x in (a ^ b).tolist() for s in range(0, 64, 4))
        errors.append((1 - slots / near_dedup.HASHES - 1 / 16) / (15 / 16) - 0.8)
        keys = near_dedup.band_keys(mins)
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0 and abs(np.mean(errors)) < 0.01 and np.min(errors) > near_dedup.ESTIMATE - 0.8


@pytest.mark.parametrize("seed,words", [(1, 2), (2, 5)])
def test_like_brute_force(spark, seed, words, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "PART", 3)
    rows = corpus(seed)
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, " \n", None), (2003, "one", "x"), (2004, "ONE", "x"), (2005, rows[0][1], "x"), (None, rows[0][1], "x"), (None, None, "x")]
    want = brute(rows, words)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), words).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(sets_of(t, words)) for i, t, *_ in rows if i is not None}
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_later_rounds(spark, monkeypatch):
    """A chain in which neighbours are similar and others aren't has no star around its smallest document."""
    monkeypatch.setattr(near_dedup, "PARTNERS", (1, None))
    words = [f"w{i}" for i in range(260)]
    rows = [(100 - k, " ".join(words[4 * k : 4 * k + 100]), "en") for k in range(30)]
    random.Random(3).shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == brute(rows, 2) and len(set(got.values())) == 1


def family(seed, near, far):
    """Texts near one of 400 words and some that are too far from it, each with changes of its own."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(near + far):
        copy = base[:]
        for _ in range(rng.randint(1, 6) if i < near else rng.randint(34, 44)):
            copy[rng.randrange(400)] = f"x{rng.randrange(10**9)}"
        rows.append((i * 7, " ".join(copy), "en"))
    return rows


def test_first_round_takes_few_partners(spark, monkeypatch):
    """A class on its own took all of a component in the first round, as it was among the few partners of each member."""
    took, across = [], near_dedup._across
    monkeypatch.setattr(near_dedup, "_across", lambda *args: took.append(near_dedup.checkpointed(across(*args))) or took[-1])
    monkeypatch.setattr(near_dedup, "PARTNERS", (1, None))
    rows = family(1, 60, 8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == brute(rows, 2) and len(set(got.values())) > 2
    first, last = (x.select("a", "b").collect() for x in took)
    assert len(first) <= 8 + 8 * 7 // 2 and len(last) > 100
    assert len({*first, *last}) == len(first) + len(last)


@pytest.mark.parametrize("many,classes,shingles,block", [(1, 5, 1 << 20, 7), (3, 2048, 2000, 2048), (30, 2048, 1 << 20, 16)])
def test_blocks_of_sets(spark, monkeypatch, many, classes, shingles, block):
    for name, value in (("MANY", many), ("BLOCK_SETS", classes), ("BLOCK_SHINGLES", shingles), ("BLOCK", block), ("PAIRS", 50)):
        monkeypatch.setattr(near_dedup, name, value)
    chain = [(10_001 - k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 100)), "en") for k in range(20)]
    again = [(i, f"{t} more words for another set", "en") for i, t, _ in family(3, 5, 5)]
    rows = family(2, 40, 9) + chain + [(i + 700, t, "en") for i, t, _ in again]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == brute(rows, 2)


def test_linked_sets():
    """Against sets in Python, with rows that share a doc_id."""
    rng = np.random.default_rng(4)
    docs = [1, 2, 2, 3, 4, 5, 6, 6]
    sets = [sorted(set(rng.integers(-12, 0, n).tolist()) | set(range(30))) for n in (3, 1, 9, 2, 14, 5, 1, 2)]
    sets[4] = [99]
    pairs = [(a, b) for a in range(1, 7) for b in range(a + 1, 7)]
    own = pa.table({"doc_id": pa.array(docs, pa.int64()), "shingles": pa.array(sets, pa.list_(pa.int64()))})
    got = near_dedup._linked(pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}), own, 85)
    like = lambda s, t: 100 * len(set(s) & set(t)) >= 85 * len(set(s) | set(t))
    want = {(a, b) for a, b in pairs if any(like(s, t) for i, s in zip(docs, sets, strict=True) for j, t in zip(docs, sets, strict=True) if (i, j) == (a, b))}
    assert set(zip(*got.to_pydict().values(), strict=True)) == want and 0 < len(want) < len(pairs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i != 20] + [(100, 90), (90, 95), (7, 7)]
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(21, 41), 21), 90: 90, 95: 90, 100: 90}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_stays(spark):
    text = "a b c d e f g h"
    rows = [(1, text, "x"), (1, text, "y"), (2, text, "z"), (3, "other words here now again", "x"), (None, text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted((r.doc_id or 0) for r in near_dedup.deduplicated(df).collect()) == [0, 1, 3]
    assert near_dedup.deduplicated(df).columns == df.columns
    assert near_dedup.deduplicated(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(df, percent=70)


def test_long_texts_ties_and_hashes(spark):
    """Texts of 60,000 words; a pair at the threshold itself and one below; Thue-Morse texts, equal under weak hashes."""
    long = [f"w{i}" for i in range(60_000)]
    # n words have n - 1 pairs; a new last word costs one of them.
    tie, below = [f"t{i}" for i in range(10)], [f"u{i}" for i in range(9)]
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(1, " ".join(long)), (2, " ".join(long[:-50])), (3, " ".join(tie)), (4, " ".join([*tie[:-1], "x"])), (5, " ".join(below)), (6, " ".join([*below[:-1], "y"])), (7, a), (8, b)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}


@pytest.mark.parametrize("most", [15, 29])
def test_bitmap_lets_all_wanted_ids_through(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "MOST_BITS", most)
    docs = spark.range(-20_000, 60_000).selectExpr("id AS doc_id", "'t' AS text")
    ids = spark.range(-3000, 30_000, 7).withColumnRenamed("id", "doc_id")
    some, rest = near_dedup.parted(docs, ids)
    got, want = {r.doc_id for r in some.collect()}, set(range(-3000, 30_000, 7))
    assert want <= got and len(got) < len(want) + (80_000 if most == 15 else 8_000)
    assert {r.doc_id for r in rest.collect()} == set(range(-20_000, 60_000)) - got
    assert [x.count() for x in near_dedup.parted(docs, ids.limit(0))] == [0, 80_000]
