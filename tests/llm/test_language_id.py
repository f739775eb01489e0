import numpy as np

from tidemark.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": "the and house with water which their about", "de": "und der schön mit wasser welche über straße", "ru": "дом вода которые через улица красивый"}


def rows():
    rng = np.random.default_rng(0)
    out = [(i, " ".join(rng.choice(words.split(), 30)), lang, "x") for i in range(60) for lang, words in WORDS.items()]
    return [(k, *r[1:]) for k, r in enumerate(out)]


def test_bundles_are_sums_of_bound_vectors():
    rng = np.random.default_rng(L.SEED)
    letters = rng.choice(np.array([-1, 1], np.int8), (L.SLOTS, L.DIMENSIONS)).astype(int)
    grams, counts = L.profile("ab a!")
    want = np.zeros(L.DIMENSIONS, int)
    for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 1, 0)):
        want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    assert counts.sum() == 4 and (L.bundle(grams, counts) == want).all()
    assert L.profile("A b") is not None and L.profile("12 !") is None and L.profile("") is None and L.profile(None) is None
    assert len(L.profile("x" * 200_000)[0]) == 3


def test_held_out_accuracy_and_edges(spark):
    extra = [(900, None, "en", "x"), (901, "", "de", "x"), (902, "123 -", None, "x"), (903, "the water", None, "x"), (None, "the house", "en", "x"), (903, "the water", None, "x")]
    df = spark.createDataFrame(rows() + extra, SCHEMA)
    got = L.identify(df).collect()
    assert len(got) == len(rows()) + len(extra)
    truth = {r[0]: r[2] for r in rows()}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {("und", 0.0)}
    assert [r.lang_pred for r in got if r.doc_id == 903] == ["en", "en"]
    assert all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert L.identify(df.limit(0)).count() == 0


def test_columns_pass_through(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = L.predict(df, L.learn(df))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert {r.lang_pred for r in L.predict(df, {}).collect()} == {"und"}


def brute_identify(rows):
    """Prototypes and predictions by plain sums over all trigrams of all texts."""
    import zlib

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
    vector = lambda t: None if L.profile(t) is None else sum(int(n) * L.bound(np.array([g]))[0].astype(np.int64) for g, n in zip(*L.profile(t), strict=True))
    sums = {}
    for i, t, lang, _ in rows:
        if lang is not None and not held(i) and (v := vector(t)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    out = []
    for i, t, _, _ in rows:
        v = vector(t)
        cosines = {} if v is None else {n: float(s @ v / np.linalg.norm(s) / np.linalg.norm(v)) for n, s in sorted(sums.items())}
        best = max(cosines, key=cosines.get) if cosines else "und"
        out.append((-1 if i is None else i, held(i), best, round(max(0.0, cosines.get(best, 0.0)), 6)))
    return sorted(out)


def test_like_brute_force(spark, monkeypatch):
    """Also if a worker lets its counts go before its rows end."""
    data = rows()[:90] + [(900, None, "en", "x"), (902, "12 -", None, "x"), (None, "the house", "en", "x"), (3, rows()[3][1], "de", "x")]
    df = spark.createDataFrame(data, SCHEMA)
    for most in (64, 1):
        monkeypatch.setattr(L, "_OPEN", most)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in L.identify(df).collect())
        assert got == brute_identify(data)
