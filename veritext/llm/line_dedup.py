"""Line dedup with DataFrame functions only: lines that occur in many
documents are dropped everywhere.

Only hashes leave the row: each line with a key sends (print, document,
position) to a range partitioning by (print, document), sorted by position
inside.  There the first row of every (print, document) is that line's first
occurrence in the document; the first occurrences are streamed into a count of
documents per print.  A line that a third of all rows share spreads over many
ranges, because the document is part of the range key, and its count is
combined before the shuffle.

What returns to a document is a compressed bitmap of its dropped lines, 64
lines a word, words without a dropped line left out; text is not sent around
for the search.  Prints with a thousandth of all lines or more - a thousand
at most, so they fit a broadcast by construction - mark their lines in place,
all other prints by a join on the print.

A line is a piece of the text between ``\\n``; its key is the line without
``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.  A print is the first 128
bits of the key's SHA-256.

Defined results: a null or empty text is one empty line; lines whose key has
fewer than ``min_chars`` code points always stay; documents are counted by
distinct id (rows that share an id are one document, null is an id), but each
row gets the bitmap of its own text; repeated rows get equal results; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

# The white space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\f\r"
#: A print with this share of all lines is marked by a broadcast (1/share prints at most).
HOT_SHARE = 0.001


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def prints(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``print, id, version, pos`` of every line that can be dropped.
    ``version`` tells the texts of rows that share an id apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("version"),
                       F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= max(1, min_chars))
    return rows.select(F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("print"), "id", "version", "pos")


def common_prints(lines: DataFrame, min_docs: int) -> DataFrame:
    """``print, n_docs, n_lines`` of the prints that ``min_docs`` documents hold."""
    # the window needs no shuffle of its own: the ranges keep each (print, id) together
    dealt = lines.repartitionByRange("print", "id")
    order = Window.partitionBy("print", "id").orderBy("pos", "version")
    first = dealt.withColumn("first", F.row_number().over(order) == 1)
    counts = first.groupBy("print").agg(F.count_if("first").alias("n_docs"), F.count("*").alias("n_lines"))
    return counts.where(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
               min_chars: int = 1) -> DataFrame:
    """``id, version, n_dropped, dropped`` of every document that loses lines;
    ``dropped`` is an array of (word, bits): bit ``i`` of word ``w`` stands for
    line ``64 w + i``."""
    lines = written(prints(docs, id_col, text_col, min_chars))
    common = written(common_prints(lines, min_docs))
    marked = common.select("print", (F.col("n_lines") >= HOT_SHARE * lines.count()).alias("hot"))

    # at most 1 / HOT_SHARE prints can hold HOT_SHARE of the lines each
    hot = marked.where("hot").select(F.col("print").alias("hot_print"))
    lines = lines.join(F.broadcast(hot), F.col("print") == F.col("hot_print"), "left")
    others = lines.where("hot_print is null").join(marked.where("not hot").select("print"), "print", "left_semi")
    gone = lines.where("hot_print is not null").unionByName(others)

    words = gone.groupBy("id", "version", F.expr("cast(pos div 64 as int)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("id", "version").agg(F.sum(F.bit_count("bits")).alias("n_dropped"),
                                              F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def dense(words: str) -> str:
    """SQL: the bitmap as an array of longs up to its last word."""
    return (f"flatten(transform({words}, (x, i) -> concat(array_repeat(0L, x.word - "
            f"if(i = 0, 0, {words}[greatest(i, 1) - 1].word + 1)), array(x.bits))))")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` per row: the bitmaps applied."""
    gone = line_dedup(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("version"))
    rows = rows.join(gone, match, "left").withColumn("lines", lines_of(F.col("text")))
    # a generated column: the bitmap is unpacked once a row, not once a line
    rows = rows.select("doc_id", "lines", "n_dropped", F.explode(F.array(F.expr(dense("dropped")))).alias("bitmap"))
    stays = "filter(lines, (x, i) -> shiftright(coalesce(get(bitmap, cast(i div 64 as int)), 0L), i % 64) & 1L = 0)"
    kept = F.when(F.col("n_dropped").isNull(), F.col("lines")).otherwise(F.expr(stays))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                       F.array_join(kept, "\n").alias("kept_text"))
