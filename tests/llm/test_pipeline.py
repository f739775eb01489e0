import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as P
from tests.llm.test_near_dedup import brute
from tidemark.llm import byte_bpe
from tests.oracle import SF_DIR


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "byte_bpe"] and P.ORACLE_SQL is None


def documents(spark):
    """Documents of the tables, and ones with nulls, repeats, a long text, and columns with names that the stages use."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(120)
    long = " ".join(f"the water of the land number {i} is under the house" for i in range(4000))
    extra = [(9001, None, "en", "src0", None), (9002, "12 34", "en", "src0", 5), (9003, "", None, None, 0), (9005, long, "en", None, len(long)), (None, "these are words of the land and the sea", "en", "src1", 3)]
    extra += [(9004, "the first and only words here in the text", None, None, 1)] * 2
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    return docs.selectExpr("*", "'r' AS row", "'g' AS gone", "7L AS block", "'s' AS score", "'d' AS `a.b`")


def test_against_brute_force(spark):
    docs = documents(spark)
    columns = docs.columns
    kept = P.identify_language(spark, docs, SF_DIR).persist()
    rejected = {r.doc_id for r in docs.select("doc_id").subtract(kept.select("doc_id")).collect()}
    assert rejected == {9001, 9002, 9003} and kept.columns == columns

    lines = P.drop_boilerplate_lines(spark, kept, SF_DIR).persist()
    rows = kept.collect()
    pages, often = {}, {}
    for r in rows:
        pages[r.source] = pages.get(r.source, 0) + 1
        for line in {x.strip(" \t\r") for x in r.text.split("\n")} - {""}:
            often[r.source, line] = often.get((r.source, line), 0) + 1
    gone = {k for k, n in often.items() if n >= 5 and 100 * n > 2 * pages[k[0]] and k[0] is not None}
    want = sorted("\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" \t\r")) not in gone) for r in rows)
    assert sorted(r.text for r in lines.collect()) == want and lines.columns == columns
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    unique = P.drop_near_duplicates(spark, lines, SF_DIR).persist()
    groups = brute([(r.doc_id, r.text) for r in lines.collect()], 5)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in unique.collect()) == sorted({*groups.values(), -1}) and unique.columns == columns

    mixed = P.mix_sources(spark, unique, SF_DIR).persist()
    assert sorted(map(str, mixed.collect())) == sorted(map(str, unique.collect())) and mixed.columns == columns

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    truth = tiktoken.Encoding("truth", pat_str=pattern, mergeable_ranks=byte_bpe.loaded(path, pattern).ranks, special_tokens={})
    out = P.tokenise(spark, mixed, SF_DIR)
    assert out.columns == [*columns, "token_ids"]
    for r in out.collect():
        assert np.array_equal(r.token_ids, truth.encode_ordinary(r.text))


def test_other_languages_go(spark):
    """Long texts of languages that weren't learned are rejected, short ones of learned languages stay."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan"
    new = [(9001, finnish, None, None, 0), (9002, "The and of that in the", None, None, 0)]
    kept = P.identify_language(spark, docs.unionByName(spark.createDataFrame(new, docs.schema)), SF_DIR)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 9001 not in ids and 9002 in ids
    assert docs.filter("length(text) > 250").join(kept, "doc_id", "left_anti").count() == 0


def test_nulls_after_the_first_stage(spark):
    docs = documents(spark).filter("doc_id > 9000 OR doc_id IS NULL")
    for _, stage in P.STAGES[1:]:
        before, docs = docs.count(), stage(spark, docs, SF_DIR)
        assert docs.count() in (before, before - 1)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
