from fractions import Fraction

import pytest

from tidemark.llm import mixing


def test_slots_meet_every_deadline():
    for shares in ({0: 500, 1: 300, 2: 224}, {0: 1, 1: 1023}, dict(enumerate([103, 7, 200, 31, 400, 283]))):
        found = list(mixing.slots((u, n, n) for u, n in shares.items()))
        total = sum(shares.values())
        assert [t for *_, t in found] == list(range(total))
        ran = dict.fromkeys(shares, 0)
        for unit, i, t in found:
            assert i == ran[unit] and i * total // shares[unit] <= t < -(-(i + 1) * total // shares[unit])
            ran[unit] += 1
            assert all(abs(ran[u] - Fraction(shares[u] * (t + 1), total)) < 1 for u in shares)


def test_each_block_runs_once():
    blocks, weights = {0: 700, 1: 90, 2: 1, 3: 40}, {0: 5.0, 1: 3.0, 2: 1.0, 3: 0.0}
    found = list(mixing.planned((u, n, weights[u]) for u, n in blocks.items()))
    assert sorted((u, i) for u, i, _ in found) == sorted((u, b) for u, n in blocks.items() for b in range(n))
    assert sorted(t for *_, t in found) == list(range(sum(blocks.values())))
    assert min(t for u, _, t in found if u == 3) > max(t for u, _, t in found if u != 3)
    assert list(mixing.planned([])) == []


def rows():
    out = [(i, "a" if i % 3 else "b" if i % 2 else None, f"text {i}", i) for i in range(700)]
    return [*out, (None, "c", None, 0), (5, "a", "text 5", 5), (5, "a", "other", 5), (9, "a", "", 9), (9, "a", "word " * 50_000, 9), *((None, "a", f"nameless {i}", 0) for i in range(60))]


def test_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string, u long")
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows()) and len({r.position for r in got}) == len(got)
    assert all(r.position // 8 == r.slot for r in got)
    counts = {}
    for r in got:
        counts[r.source, r.block] = counts.get((r.source, r.block), 0) + 1
    assert max(counts.values()) == 8 and len({r.slot for r in got}) == len(counts)
    mixed = mixing.mixed(df, {"a": 3, "b": 1})
    assert mixed.columns == df.columns
    assert sorted(r.place for r in mixing.mixed(df, position="place").collect()) == sorted(r.position for r in got)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, df.collect()))
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_weights_are_met(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    df = spark.createDataFrame([(i, s, "") for i, s in enumerate("a" * 300 + "b" * 300)], "doc_id long, source string, text string")
    order = [r.source for r in mixing.mix_report(df, {"a": 3, "b": 1}).orderBy("position").collect()]
    for n in range(1, 390):
        assert abs(order[:n].count("a") - 0.75 * n) < 1.1
    assert order[400:] == ["b"] * 200


def ideal(blocks, weights, t):
    """Blocks of each unit that the ideal mix has run after t slots, by water filling."""
    left, total, out = set(blocks), t, {}
    while True:
        v = total / sum(weights[u] for u in left) if left else 0
        full = {u for u in left if blocks[u] <= weights[u] * v}
        if not full:
            return out | {u: weights[u] * v for u in left}
        out |= {u: Fraction(blocks[u]) for u in full}
        total -= sum(blocks[u] for u in full)
        left -= full


@pytest.mark.parametrize("weights", [[0.7, 0.2, 0.1], [1.0, 1e-5, 0.3], [0.5, *[0.5 / 255] * 255], [n**0.5 for n in range(1, 20)]])
def test_exact_weights_on_long_runs(weights):
    """Every unit stays within one block of its true weight, also after others have run out."""
    exact = {u: Fraction(w) for u, w in enumerate(weights)}
    blocks = {u: 3_000 if u == 0 else 9 * (u + 1) if len(weights) > 3 else 5_000 // u for u in exact}
    place = {}
    for u, _, t in mixing.planned((u, n, weights[u]) for u, n in blocks.items()):
        place[t] = u
    ran = dict.fromkeys(blocks, 0)
    for slot in range(sum(blocks.values())):
        ran[place[slot]] += 1
        if slot % 499 == 0 or slot < 20:
            due = ideal(blocks, exact, Fraction(slot + 1))
            assert all(abs(ran[u] - due[u]) < 1 for u in blocks)
    assert ran == blocks


def test_schedule_is_the_same_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "abcd"[i % 7 % 4], None) for i in range(2_000)], "doc_id long, source string, text string")
    want = sorted(map(tuple, mixing.mix_report(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert sorted(map(tuple, mixing.mix_report(df).collect())) == want


def test_many_sources_keep_their_own_weights(spark, monkeypatch):
    """With more than 256 sources each is scheduled by itself, and one without a weight runs after all others."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    sources = [None, "hot", *(f"s{i}" for i in range(300))]
    rows = [(1_000 * k + i, s, f"text {i}") for k, s in enumerate(sources) for i in range(600 if s == "hot" else 2 + k % 4)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {s: 0.0 if s == "s7" else 150.0 if s == "hot" else 0.5 for s in sources if s != "s9"}
    got = mixing.mix_report(df, weights).collect()
    assert len(got) == df.count() == len({r.position for r in got})
    counts, at = {}, {}
    for r in got:
        counts[r.source, r.block] = counts.get((r.source, r.block), 0) + 1
        at[r.slot] = r.source
    assert max(counts.values()) == 2 and len(at) == len(counts) == max(at) + 1
    last = {s for r in got if (s := r.source) in ("s7", "s9")}
    assert last == {"s7", "s9"} and min(t for t, s in at.items() if s in last) > max(t for t, s in at.items() if s not in last)
    blocks = {s: n for s in sources if s not in last and (n := len([1 for u, _ in counts if u == s]))}
    ran = dict.fromkeys(blocks, 0)
    for slot in range(sum(blocks.values())):
        ran[at[slot]] += 1
        if slot % 60 == 0:
            due = ideal(blocks, {s: Fraction(weights[s]) for s in blocks}, Fraction(slot + 1))
            assert all(abs(ran[s] - due[s]) < 1 for s in blocks)


def test_texts_move_twice(spark):
    """Once to be ranked and once into the order of the mix, whatever Spark knows of the table's size; no join moves them again."""
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3], f"text {i}") for i in range(300)], "doc_id long, source string, text string").checkpoint()
    plan = mixing.mixed(df)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoop" not in plan
    assert plan.count("Window [row_number") == 1
