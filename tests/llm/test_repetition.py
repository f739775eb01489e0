import random
import re
from collections import Counter

import pyarrow as pa

from tidemark.llm import repetition as R


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    for n in R.NGRAM_PERCENT:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}
        out[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in inside)
        if n == 5:
            out["n_repeat_words"] = len(inside)
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    seen, dup = set(), []
    for line in lines:
        if line in seen:
            dup.append(line)
        seen.add(line)
    return out | {"n_lines": len(lines), "n_dup_lines": len(dup), "dup_line_chars": sum(len(w) for line in dup for w in re.findall("[^\x20\x09-\x0d]+", line))}


def texts():
    rng = random.Random(4)
    out = [None, "", " ", "\n\n", "a", "a b c d e a b c d e", "x " * 5000, "é\xa0ü #\n é\n é", "\ta\r\n\ta\r\nb\x0b#<", "ab\nab \nab"]
    for _ in range(150):
        w = [rng.choice(["the", "of", "é", "#x", "long-word", "日本", "<p>"]) for _ in range(rng.randint(0, 80))]
        out.append("".join(x + rng.choice([" ", "\n", "  ", "\r\n", "\t"]) for x in w))
    return out


def test_like_brute_force():
    m = R.measures(pa.array(texts(), pa.string()))
    for i, t in enumerate(texts()):
        assert {k: int(v[i]) for k, v in m.items()} == brute(t), repr(t)


def test_table(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean, "a"), (2, "a b c d e " * 9, "b"), (3, None, "c"), (None, clean, None), (1, clean, "a"), (4, clean + "\n" + "\n".join(["one long line of boilerplate text here"] * 9), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = [(r.doc_id, r.base_failed, r.kept) for r in R.repetition_rules(df).collect()]
    assert sorted(got, key=str) == sorted([(1, False, True), (2, True, False), (3, True, False), (None, False, True), (1, False, True), (4, True, False)], key=str)
    assert R.repetition_rules(df.limit(0)).count() == 0
