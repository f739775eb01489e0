import random
import re
import textwrap

import numpy as np
import pytest

from tidemark.llm import license_scan as S

PLAIN = [f"The river number {i} runs through a quiet valley and past {i * 7} houses of the town." for i in range(60)]
GPL = " ".join([S.TEMPLATES["GPL"][2] + ", either version 3 of the License, or (at your option) any later version.", S.TEMPLATES["GPL"][4]])
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use or distribute this software"


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PLAIN)], "doc_id long, text string")
    return S.LicenseModel.fit(spark, S.passages(df, S.vocabulary()))


def families(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [set() for _ in texts]
    for r in S.scan(df, model).collect():
        got[r.doc_id].add(r.family)
    return got


def test_rows(spark, model):
    mit = S.TEMPLATES["MIT"]
    rows = [(1, "Intro text.\nReleased under the MIT License.\nmore", "x"), (2, mit[2].upper(), "x"), (3, "Licensed under CC BY-SA 4.0.", "x"), (4, "Licensed under CC BY 4.0.", "x")]
    rows += [(5, "This work is licensed under the Purple Dragon License", "x"), (6, None, "x"), (7, "", "x"), (None, "All rights reserved.", "x"), (1, rows[0][1], "x")]
    rows += [(100 + i, t, "x") for i, t in enumerate(PLAIN[:20])] + [(8, "the river lost its way under the bridge", "x"), (9, "word " * 50_000 + mit[0], "x"), (10, "word", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    out = S.scan(df, model)
    got = sorted((r.doc_id or 0, r.place, r.family) for r in out.collect())
    assert got == [(0, 0, "proprietary"), (1, 2, "MIT"), (2, 0, "MIT"), (3, 0, "CC-BY-SA"), (4, 0, "CC-BY"), (5, 0, "unknown"), (9, 50_000, "MIT")]
    assert all(0 <= r.probability <= 1 and 0 <= r.match <= 1 for r in out.collect())
    assert S.scan(df.limit(0), model).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


def test_wrapping_doesnt_matter(spark, model):
    mit, bsd, apache = (" ".join(S.TEMPLATES[n][1:]) for n in ("MIT", "BSD", "Apache-2.0"))
    for width in (40, 70):
        got = families(spark, model, ["\n".join(textwrap.wrap(t, width)) for t in (GPL, mit, bsd, apache)])
        assert got == [{"GPL"}, {"MIT"}, {"BSD"}, {"Apache-2.0"}]


def test_unknown_and_none(spark, model):
    licences = [ISC, UNLICENSE, "Released under the Eclipse Public License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "Distributed under the ISC License."]
    others = ["all rights reserved for members of the choir", "he was licensed by the guild", "The permission slip was lost.", "Her license to practise ended in May.", "They met under the terms of the truce."]
    assert families(spark, model, licences) == [{"unknown"}] * len(licences)
    assert families(spark, model, others + PLAIN) == [set()] * (len(others) + len(PLAIN))


def test_several_in_one_passage(spark, model):
    both = "Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert families(spark, model, [both]) == [{"MIT", "Apache-2.0"}]


def test_templates_in_other_text(spark, model):
    names = [n for n, texts in sorted(S.TEMPLATES.items()) for _ in texts]
    texts = ["Note: " + t.replace(".", " ;") + " (see file)" for _, texts in sorted(S.TEMPLATES.items()) for t in texts]
    got = families(spark, model, texts)
    assert sum(n in g for n, g in zip(names, got, strict=True)) >= 0.9 * len(names)


def brute_passages(text, vocab):
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    hits = [(i, g) for i, w in enumerate(words) for g in (w, " ".join(words[i : i + 2])) if g in vocab]
    out = []
    for i, gram in hits:
        if out and i - out[-1][-1][0] <= S.GAP:
            out[-1].append((i, gram))
        else:
            out.append([(i, gram)])
    return [(p[0][0], max(i + len(g.split()) for i, g in p) - p[0][0], sorted({g for _, g in p})) for p in out]


def brute_scan(text, model):
    """Rows (place, n_words, family, probability, match) by numpy from the regression's numbers."""
    at, rows = {g: i for i, g in enumerate(model.vocab)}, []
    matrix, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    for place, n, grams in brute_passages(text, at):
        z = bias + matrix[:, [at[g] for g in grams]].sum(axis=1)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if 1 - p[0] < model.threshold:
            continue
        share = [0.0, 0.0] + [max(len(set(grams) & set(S.pairs_of(t))) / len(set(S.pairs_of(t))) for t in S.TEMPLATES[n]) for n in model.names[2:]]
        best = 1 + int(np.argmax(p[1:]))
        others = [k for k in range(2, len(p)) if share[k] >= S.WHOLE and k != best] if best > 1 else []
        mine = [best] if best > 1 and share[best] >= S.CONFIRM else others or [1]
        for k in sorted({*mine, *others}):
            rows.append((place, n, model.names[k], round(1 - p[0] if k == 1 else p[k], 5), round(share[best if k == 1 else k], 5)))
    return rows


def test_like_brute_force(spark, model):
    texts = [t for f in S.TEMPLATES.values() for t in f] + list(S.OTHERS) + list(S.NEAR_MISSES) + [GPL, ISC, UNLICENSE]
    texts += [" ".join(texts[i : i + 3]) for i in range(0, len(texts), 3)] + [a + " filler" * 20 + " " + b for a, b in zip(texts[::5], texts[1::5], strict=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.place, r.n_words, r.family, round(r.probability, 5), round(r.match, 5)) for r in S.scan(df, model).collect())
    wanted = sorted((i, *row) for i, t in enumerate(texts) for row in brute_scan(t, model))
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in wanted], atol=2e-5)


def test_threshold():
    assert S.best_threshold([(0.1, 0), (0.2, 0), (0.4, 1), (0.9, 1)]) == pytest.approx(0.3)
    assert S.best_threshold([(0.1, 0), (0.99, 0), (0.98, 1), (0.97, 1), (0.5, 0)]) == pytest.approx(0.735)
    assert S.best_threshold([(0.001, 0), (0.002, 1)]) == 0.05 and S.best_threshold([]) == 0.5


def test_every_passage_counts(spark, monkeypatch):
    """All distinct passages without a template are trained on or calibrated with, however many there are."""
    monkeypatch.setattr(S, "NEGATIVES", 3)
    rng, vocab = random.Random(2), S.vocabulary()
    rows = [(i, " ".join(rng.sample(vocab, rng.randint(1, 6)))) for i in range(150)]
    found = S.passages(spark.createDataFrame(rows, "doc_id long, text string"), vocab)
    share = lambda g: max(len(set(g) & set(S.pairs_of(t))) / len(set(S.pairs_of(t))) for t in [*sum(S.TEMPLATES.values(), ()), *S._parts(S.OTHERS)[0]])
    plain = {g for r in found.collect() if share(g := tuple(r.grams)) < S.CONFIRM}
    fitted, seen = S.LogisticRegression.fit, []
    monkeypatch.setattr(S.LogisticRegression, "fit", lambda self, df: seen.append(df) or fitted(self, df))
    model = S.LicenseModel.fit(spark, found)
    corpus = {tuple(r.grams): r.weight for r in seen[0].collect() if r.weight < 1}
    kept = plain - set(corpus)
    assert set(corpus) < plain and len(kept) > 30 and sum(corpus.values()) == pytest.approx(3)
    none = [S.features_of(t) for t in S._parts(S.NEAR_MISSES)[1]] + list(map(list, kept))
    sure = [S.features_of(t) for t in S._parts(S.OTHERS)[1]] + [S.features_of(t) for f in S.TEMPLATES.values() for t in f]
    tests = spark.createDataFrame([(1, g) for g in sure] + [(0, g) for g in none], "licence int, grams array<string>")
    assert model.threshold == pytest.approx(S.best_threshold([(1 - r.p[0], r.licence) for r in model.scored(tests).collect()]))
