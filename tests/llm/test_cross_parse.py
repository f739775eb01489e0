import random
from math import log2

import numpy as np
import pytest

from tidemark.llm import cross_parse as Z


def brute_lengths(words, others, depth):
    """At each place the longest run of up to ``depth`` words that another text has; from there on, word by word."""
    runs = {tuple(t[i : i + k]) for t in others for k in range(1, depth + 1) for i in range(len(t) - k + 1)}
    out = []
    for i in range(len(words)):
        n = 1
        while n < depth and i + n < len(words) and tuple(words[i : i + n + 1]) in runs:
            n += 1
        while n >= depth and i + n < len(words) and tuple(words[i + n - depth + 1 : i + n + 1]) in runs:
            n += 1
        out.append(n)
    return out


def brute_longest(words, others):
    """At each place the longest run that another text has, at least 1."""
    have = lambda s: any(t[i : i + len(s)] == s for t in others for i in range(len(t) - len(s) + 1))
    return [max([1, *(n for n in range(1, len(words) - i + 1) if have(words[i : i + n]))]) for i in range(len(words))]


def brute_phrases(lengths):
    i = phrases = 0
    while i < len(lengths):
        i, phrases = i + lengths[i], phrases + 1
    return phrases


def brute_own(symbols):
    seen, now, n = set(), (), 0
    for s in symbols:
        now += (s,)
        if now not in seen:
            seen.add(now)
            n, now = n + 1, ()
    return n + bool(now)


def test_parts_like_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        own = [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]
        assert Z.own_phrases(own) == brute_own(own)
        lengths = [rng.randint(1, 4) for _ in own]
        assert Z.greedy_phrases(np.array(lengths, np.int64)) == brute_phrases(lengths)
        x = np.array([rng.randint(0, 2**63) for _ in own], np.uint64)
        assert (Z._unpack(Z._pack(x), len(x), np.uint64) == x).all()
    assert Z.entropy(0, 0, 0, 9) is None and Z.entropy(8, 4, 2, 16) == pytest.approx((4 * log2(16) - 2) / 8)
    assert Z.match_lengths(np.array([3, 3, 2, 1, 3, 2, 1]), 3).tolist() == [4, 3, 2, 1, 3, 2, 1]


def corpus():
    rng = random.Random(1)
    vocabulary = "the cat sat on a mat and ran to its home".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(36)]
    texts += [" ".join(f"q{rng.randint(0, 99)}" for _ in range(30)) for _ in range(4)]
    passage = " ".join(f"p{i}" for i in range(25))
    texts += ["start " + passage, passage.upper() + " end", texts[3], " ".join(f"u{i}" for i in range(30)), "w " * 300]
    return [(i, t, "x") for i, t in enumerate(texts)] + [(200, None, "x"), (201, "", None), (None, texts[0], "x"), (3, texts[3], "again")]


def words_of(text):
    return (text or "").lower().split()


@pytest.mark.parametrize("sizes", [(300, 40), (1 << 20, 1 << 19)])
@pytest.mark.parametrize("depth", [3, 8])
@pytest.mark.parametrize("trusting", [False, True])
def test_table_like_brute_force(spark, monkeypatch, sizes, depth, trusting):
    """However documents are dealt to blocks and runs to buckets."""
    monkeypatch.setattr(Z, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(Z, "BUCKET_RUNS", sizes[1])
    monkeypatch.setattr(Z, "DEPTH", depth)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    sure = {*range(0, 45, 2), 3} if trusting else None
    trusted = spark.createDataFrame([(i, "y") for i in [*sure, 4, None, 777]], "doc_id long, text string") if trusting else None
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_phrases, r.n_own_phrases, r.score) for r in Z.cross_parse(df, trusted).collect())
    total = sum(len(words_of(t)) for i, t, _ in rows if sure is None or i in sure)
    wanted = []
    for k, (i, t, _) in enumerate(rows):
        own = words_of(t)
        others = [words_of(u) for m, (j, u, _) in enumerate(rows) if m != k and (sure is None or j in sure)]
        cross = brute_phrases(brute_lengths(own, others, depth))
        left = total - len(own) * (sure is None or i in sure)
        wanted.append((-1 if i is None else i, len(own), cross, brute_own(own), Z.entropy(len(own), cross, brute_own(own), left)))
    assert got == sorted(wanted)
    score = {i: s for i, *_, s in got}
    # Repeated texts and passages cost little, unheard words much.
    assert trusting or max(score[3], score[40]) < min(score[i] for i in (36, 37, 38, 39, 43))


def test_longest_matches(spark):
    """Where no two matches overlap in DEPTH - 1 words, the phrases are those of the longest matches of any length."""
    rng = random.Random(3)
    passages = [[f"{c}{i}" for i in range(n)] for c, n in zip("abcd", (3, 9, 20, 33), strict=True)]
    texts = [[w for _ in range(6) for w in (*rng.choice(passages)[: rng.randint(1, 40)], f"u{rng.random()}")] for _ in range(12)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_phrases for r in Z.cross_parse(df).collect()}
    same = [got[i] == brute_phrases(brute_longest(t, texts[:i] + texts[i + 1 :])) for i, t in enumerate(texts)]
    assert all(same)


def test_without_a_reference(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long")
    assert all(r.n_phrases == r.n_words for r in Z.cross_parse(df, none).collect())
    assert Z.cross_parse(df.limit(0)).count() == 0
    assert [r.n_phrases for r in Z.cross_parse(df.filter("doc_id = 44")).collect()] == [300]


def edited_copies():
    """Copies with edits, pieces that overlap in many words, repeats inside a text, and rows that are equal."""
    rng = random.Random(8)
    base = [[f"{c}{rng.randint(0, 60)}" for _ in range(n)] for c, n in zip("abc", (150, 70, 40), strict=True)]
    texts = []
    for _ in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"u{rng.randint(0, 3)}"
        start = rng.randrange(len(t) // 2)
        texts.append(t[start : start + rng.randint(1, 150)] + rng.choice([[], rng.choice(base)[rng.randint(0, 30) :]]))
    return [*texts, texts[0], texts[0], ["w"] * 60, ["w"] * 40, base[2] * 3, base[2] * 2, []]


@pytest.mark.parametrize("sizes", [(300, 40), (1 << 20, 1 << 19)])
@pytest.mark.parametrize("depth", [2, 3, 8])
@pytest.mark.parametrize("trusting", [False, True])
def test_exact_matches_of_any_length(spark, monkeypatch, sizes, depth, trusting):
    monkeypatch.setattr(Z, "BLOCK_BYTES", sizes[0])
    monkeypatch.setattr(Z, "BUCKET_RUNS", sizes[1])
    monkeypatch.setattr(Z, "DEPTH", depth)
    texts = edited_copies()
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sure = [i for i in range(len(texts)) if not trusting or i % 3]
    got = {r.doc_id: r.n_phrases for r in Z.cross_parse(df, df.filter("doc_id % 3 > 0") if trusting else None, exact=True).collect()}
    padded = [f" {' '.join(t)} " for t in texts]

    def longest(i):
        out, others = [], "\n".join(padded[j] for j in sure if j != i)
        for a in range(len(texts[i])):
            n = 1
            while a + n < len(texts[i]) and f" {' '.join(texts[i][a : a + n + 1])} " in others:
                n += 1
            out.append(n)
        return out

    assert got == {i: brute_phrases(longest(i)) for i in range(len(texts))}


def test_query_joins_no_matches(spark, tmp_path):
    """Ten words of one document and ten of another that share eight are no match of twelve."""
    from tidemark.llm import queries

    words = [f"p{i}" for i in range(12)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:10], "x"])), (2, " ".join(["y", *words[2:]]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_phrases for r in queries.op9_cross_parse(spark, str(tmp_path)).collect()} == {0: 2, 1: 2, 2: 2}
