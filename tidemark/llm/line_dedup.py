r"""Line dedup by site-relative frequency, in DataFrame expressions only.

For each host, the pages that contain a line are divided by the host's pages; a line on more than ``percent`` percent of
them, and on ``least_pages`` at least, is boilerplate and dropped from every page of the host. Lines are split at \n and
compared by 64-bit hash after blanks, tabs and carriage returns are trimmed; a page counts once however often it
repeats the line. Counts are keyed by host and line, so one hot host is spread over all tasks.

A host has at most (lines per page) * 100 / percent boilerplate lines, whatever its size. They are broadcast if their
number, which is counted first, is at most BROADCAST_LINES over all hosts; else pages are joined by host and salt.

Edge cases: a null text stays null and counts as a page without lines; lines without a visible character are neither
counted nor dropped; pages with a null host are left as they are; a text whose lines all go becomes empty and its row
stays; long texts are handled whole; repeated rows are pages of their own; all other columns pass through, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Boilerplate lines over all hosts that are still broadcast: 16 MB of hashes.
BROADCAST_LINES = 2_000_000
#: Parts of each host when they aren't.
SALTS = 64


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, host: str, text: str, percent: float, least_pages: int) -> DataFrame:
    """Per host with any: host and gone, the hashes of its boilerplate lines."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).filter("host is not null")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    full = F.filter(F.transform(F.split("text", "\n", -1), _key), lambda x: x != "")
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(full, lambda x: F.xxhash64(x)))).alias("line"))
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    return often.join(totals, "host").filter(100 * F.col("n") > percent * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("gone"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: float = 2, least_pages: int = 5) -> DataFrame:
    """Every row of ``docs`` without its boilerplate lines as the struct ``row``, with n_lines and n_dropped."""
    found = checkpointed(boilerplate(docs, host, text, percent, least_pages))
    total = found.agg(F.sum(F.size("gone"))).first()[0] or 0
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    if total <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
        joined = salted.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x: (_key(x) == "") | ~F.array_contains("gone", F.xxhash64(_key(x))))
    joined = joined.withColumn("kept", F.when(F.col("gone").isNull(), lines).otherwise(kept)).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    return joined.select(
        F.col("row").withField(text, F.array_join("kept", "\n")).alias("row"),
        "n_lines",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def line_report(docs: DataFrame, host: str = "source", percent: float = 2, least_pages: int = 5) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the text that is left."""
    out = drop_boilerplate(docs.select("doc_id", host, "text"), host, "text", percent, least_pages)
    return out.select("row.doc_id", "n_lines", "n_dropped", "row.text")
