"""Dedup of lines that many documents share, in DataFrame functions.

Lines are exploded with their positions; the key of a line is the line without
blanks at its ends, A-Z lower-cased. Keys of `least` code points or more are
hashed (128 bits of SHA-256), and distinct documents are counted for each hash:
once by hash and document, then by hash with partial counts, so a line of every
document is spread until only counts are left. Lines whose hash is in `often`
documents or more go, except in the document with the largest id that holds
it. Hashes, not lines, are shuffled.

Which lines go is joined back by position: the at most HOT hashes that hold
most rows are broadcast, all others are rare and join by shuffle. A document's
lines then travel once, to its dropped positions, and those left are put
together in order.

Defined cases: a null or empty text is one empty line; a null id is one
document, smaller than all others; rows that repeat an id are one document, and
each row loses the lines that its document loses; a line repeated within a
document counts once and goes or stays with all its copies; an empty table gives
an empty result; other columns are carried by `drop_lines` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import cut, unique_name

LEAST, OFTEN = 40, 5
#: Hashes that are broadcast, at most.
HOT = 2048
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _text_mark(text: Column) -> Column:
    """Tells rows apart that repeat an id."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def keyed_lines(df: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """id, mark, pos, hash of every line that is long enough."""
    key = line_key(F.col("line"))
    lines = df.select(F.col(id_col).alias("id"), _text_mark(F.col(text_col)).alias("mark"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    long = lines.select("id", "mark", "pos", key.alias("key")).where(F.char_length("key") >= least)
    return long.select("id", "mark", "pos", F.substring(F.unhex(F.sha2(F.col("key").cast("binary"), 256)), 1, 16).alias("hash"))


def shared_lines(lines: DataFrame, often: int = OFTEN) -> DataFrame:
    """hash, n (distinct documents) and last (largest id) of lines that `often`
    documents or more hold."""
    found = lines.select("hash", "id").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    return found.where(F.col("n") >= often)


def dropped_positions(df: DataFrame, id_col: str, text_col: str, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """id, mark, gone: the positions of the lines that a text loses."""
    lines = cut(keyed_lines(df, id_col, text_col, least))  # hashes only
    shared = cut(shared_lines(lines, often))
    # At most HOT hashes can each hold a share of 1 / HOT of the counted documents.
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") * HOT >= total).select("hash", "last", F.lit(True).alias("hot"))
    marked = lines.join(F.broadcast(hot), "hash", "left")
    elsewhere = ~F.col("id").eqNullSafe(F.col("last"))
    settled = marked.where(F.col("hot")).where(elsewhere)
    rest = marked.where(F.col("hot").isNull()).drop("last", "hot").join(shared.where(F.col("n") * HOT < total).select("hash", "last"), "hash").where(elsewhere)
    gone = settled.select("id", "mark", "pos").unionByName(rest.select("id", "mark", "pos"))
    return gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """All columns, the text without the lines that go, and how many lines the
    text had and how many went. A text that loses nothing stays as it is."""
    mark, lines = unique_name(df, "_mark"), unique_name(df, "_lines")
    gone = dropped_positions(df, id_col, text_col, least, often).select(F.col("id").alias("_gone_id"), F.col("mark").alias("_gone_mark"), F.col("gone").alias("_gone"))
    # Split before the join: behind it the split would be repeated for every position.
    whole = df.withColumns({mark: _text_mark(F.col(text_col)), lines: lines_of(F.col(text_col))})
    met = whole.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("_gone_id")) & (F.col(mark) == F.col("_gone_mark")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    counts = {n_lines: F.size(lines).cast("long"), n_dropped: F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return met.withColumns({text_col: F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(text), **counts}).drop(mark, lines, "_gone_id", "_gone_mark", "_gone")


def listing(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept_sha256."""
    left = drop_lines(df.select(id_col, text_col), id_col, text_col)
    return left.select(id_col, "n_lines", "n_dropped", F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256).alias("kept_sha256"))
