import pytest

from tidemark.llm import line_dedup as D


def rows():
    out = [(i, f"Menu | Home\nbody {i}\n\n\tfooter\r", "big", "h") for i in range(40)]
    out += [(100 + i, f"Menu | Home\npage {i}", "other" if i < 2 else "big", "h") for i in range(4)]
    return [*out, (200, None, "big", "h"), (201, "", "big", "h"), (202, "Menu | Home", None, "h"), (None, "Menu | Home\nMenu | Home", "big", "h"), (0, out[0][1], "big", "h")]


@pytest.mark.parametrize("most", [10**6, 0])
def test_lines(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_LINES", most)
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, host string")
    got = [tuple(r) for r in D.line_report(df).collect()]
    assert len(got) == len(rows())
    by = {g[0]: g[1:] for g in got}
    assert by[7] == (4, 2, "body 7\n")
    assert by[100] == (2, 0, "Menu | Home\npage 0") and by[102] == (2, 1, "page 2")
    assert (by[200], by[201], by[202], by[None]) == ((0, 0, None), (1, 0, ""), (1, 0, "Menu | Home"), (2, 2, ""))
    whole = D.drop_boilerplate(df)
    assert whole.select("row.*").columns == df.columns
    assert D.line_report(df.limit(0)).count() == 0


def test_long_texts_and_ties(spark):
    """A share at the ratio itself stays; a long text is handled whole."""
    long = "\n".join(f"line {i}" for i in range(60_000)) + "\nfooter"
    texts = [long, *(f"page {i}\nfooter\nsome" for i in range(9)), *(f"page {i}\nsome" for i in range(9, 19)), *(f"other {i}" for i in range(81))]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in D.line_report(df, percent=10, least_pages=3).collect()}
    assert out[0] == (60_001, 0, long) and out[3] == (3, 1, "page 2\nfooter")
