"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets ``k`` cells for the digest of every text and keeps, as one bit each, the cells that
were set at least twice. Pass 2 asks for every digest whether all its cells have that bit: if
not, its text occurs once and the row passes straight through; else the row may be repeated and
is shuffled by its digest, which decides exactly.

Edge cases: a null text is the empty text; a null id sorts behind all others; of rows that are
equal in id and text one stays. Other columns are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuscope.llm.common import SPACES, hold, text_of, whole_rows

#: Cells of the filter per row, and the most cells. The filter is sent to every task, so its size
#: is bounded (2**26 bits are 8 MB); beyond that it fills up and lets more rows be shuffled.
CELLS_PER_ROW, MAX_CELLS = 8, 2**26
#: Parts of a digest's group, so that a text copied into a third of all rows is no single task.
SALTS = 32


def digest(text: str = "text") -> Column:
    """SHA-256 (lowercase hex) of the text with white-space runs replaced by one space."""
    return F.sha2(F.regexp_replace(text_of(text), SPACES, " ").cast("binary"), 256)


def _cells(n_cells: int) -> list[Column]:
    return [F.conv(F.substring("text_sha256", at, 13), 16, 10).cast("bigint").bitwiseAND(F.lit(n_cells - 1)) for at in (1, 17)]


def repeat_filter(keyed: DataFrame, n_cells: int) -> DataFrame:
    """One row: the cells set twice or more, as an array of 64-bit words."""
    cells = keyed.select(F.explode(F.array(*_cells(n_cells))).alias("cell"))
    twice = cells.groupBy("cell").count().filter("count >= 2")
    words = (twice.select(F.shiftright("cell", 6).alias("word"), F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    every = keyed.sparkSession.range(n_cells // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    dense = words.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("s")).select(F.col("s.bits").alias("filter"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                cells_per_row: int = CELLS_PER_ROW, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = hold(docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("text_sha256"))
                      .withColumn("row", F.monotonically_increasing_id()))
    wanted = max(64, keyed.count() * cells_per_row)
    n_cells = min(max_cells, 1 << (wanted - 1).bit_length())
    bits = repeat_filter(keyed, n_cells).scalar()
    seen = keyed.withColumn("_filter", bits)
    maybe = F.lit(True)
    for cell in _cells(n_cells):
        word = F.element_at("_filter", (F.shiftright(cell, 6) + 1).cast("int"))
        maybe = maybe & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), cell.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    seen = seen.withColumn("maybe", maybe).drop("_filter")
    alone = seen.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                                F.lit(True).alias("kept"), "text_sha256")
    several = seen.filter("maybe").withColumn("salt", F.pmod("row", F.lit(SALTS)))
    parts = several.groupBy("text_sha256", "salt").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("n"))
    whole = parts.groupBy("text_sha256").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
    groups = whole.select("text_sha256", "first", "group_size", F.explode("salts").alias("salt"))
    grouped = several.join(groups, ["text_sha256", "salt"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the later copies of a text, with all their columns.

    Only the ids of dropped rows meet the documents; rows that repeat an id with the same text
    are left to one by their number within id and digest.
    """
    found = exact_dedup(docs, doc_id, text)
    gone = (found.filter("not kept").groupBy("doc_id", "text_sha256")
            .agg(F.max(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("own"))
            .select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), "own"))
    keyed = whole_rows(docs, id=F.col(doc_id), sha=digest(text))
    joined = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left")
    whole = joined.filter(F.col("own").isNull()).select("_doc.*")
    # ids of which one row was kept and others dropped as its repeats: one row of each stays
    own = joined.filter(F.col("own")).dropDuplicates(["id", "sha"]).select("_doc.*")
    return whole.unionByName(own)
