"""Removal of repeated multi-line chunks, in DataFrame operations only.

Where a text is cut into chunks depends on its lines alone: a rolling hash over the hashes of the last
lines ends a chunk, so that lines that are put in or left out move no later boundary. Chunks of several
lines whose hash occurs more than once are compared byte for byte; all but the first go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Shielded, cut
from wardline.llm.repeats import place, rows_of, without

#: Lines under the rolling hash, and the mean number of lines of a chunk.
ROLL, MEAN = 2, 3


def lines(text: Column) -> Column:
    """The lines with their line feeds; together they are the text."""
    return F.regexp_extract_all(text, F.lit(r"[^\n]*+\n|[^\n]++"), F.lit(0))


def _rolled(i: Column) -> Column:
    """Hashes of the lines up to the i-th, each turned by its distance; lines before the first count as null."""
    out = F.get("hashes", i)
    for k in range(1, ROLL):
        older = F.coalesce(F.get("hashes", i - k), F.lit(0).cast("long"))
        out = out.bitwiseXOR(F.shiftleft(older, 21 * k).bitwiseOR(F.shiftrightunsigned(older, 64 - 21 * k)))
    return out


def chunks(docs: DataFrame, key: str, text: str, lone: bool = True) -> DataFrame:
    """id, mark, s, e (first and last line), chunk (bytes without the last line feed), h of all multi-line chunks.

    Without `lone` no chunk has one line: an end right after another one, after the first line or before the
    last line is none, so that every line lies in a chunk that is compared."""
    rows = rows_of(docs, key, text, lines).where("size(parts) > 1")
    rows = rows.withColumn("hashes", F.transform("parts", lambda x: F.xxhash64(F.rtrim(x, F.lit("\n")))))
    last, rolled = F.size("parts") - 1, lambda i: F.pmod(_rolled(i), F.lit(MEAN)) == 0
    inner = rolled if lone else lambda i: (i > 0) & (i != last - 1) & rolled(i) & ((i == 1) | ~rolled(i - 1))
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | inner(i))
    rows = rows.withColumn("ends", ends)
    spans = F.transform("ends", lambda e, k: F.struct(F.coalesce(F.get("ends", k - 1) + 1, F.lit(0)).alias("s"), e.alias("e")))
    rows = rows.select("id", "mark", "parts", F.inline(F.filter(spans, lambda x: x.e > x.s)))
    rows = rows.withColumn("chunk", F.rtrim(F.array_join(F.slice("parts", F.col("s") + 1, F.col("e") - F.col("s") + 1), ""), F.lit("\n")))
    return rows.select("id", "mark", "s", "e", "chunk", F.xxhash64("chunk").alias("h"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", lone: bool = True) -> DataFrame:
    """`docs` with n_lines, n_removed and the text without repeated chunks (columns of these names are replaced).

    The first occurrence of a chunk by key, then place, stays. Null stays null; empty and one-line texts
    stay as they are; rows that repeat key and text are one document, rows with the same key and other
    texts are ordered by a hash of them; null keys come first. Empty tables stay empty. Joins are merge joins
    at every size, whose skewed keys the planner splits. A text of any length is one row; its lines and chunks
    are in memory together. Columns of any name pass through.
    With `lone`, chunks of one line occur and always stay; see chunks().
    """
    own = Shielded(docs)
    docs, key_, text_ = own.docs, own[key], own[text]
    all_ = chunks(docs, key_, text_, lone)
    twice = cut(all_.groupBy("h").agg(F.min(place("s")).alias("x"), F.max(place("s")).alias("y")).where("x <> y").select("h"), "hashes")
    again = cut(all_.join(twice.hint("merge"), "h", "left_semi").withColumn("place", place("s")), "chunks")
    # grouping by the bytes themselves is the comparison: chunks of one hash and other bytes stay apart
    first = again.groupBy("h", "chunk").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    first = cut(first.select(F.col("h").alias("h_"), F.col("chunk").alias("chunk_"), "first"), "first")
    gone = again.join(first.hint("merge"), (F.col("h") == F.col("h_")) & (F.col("chunk") == F.col("chunk_"))).where("place <> first").select("id", "mark", "s", "e")
    out = without(docs, gone, key_, text_, lines)
    return out.select(*own.columns(text, "n_lines", "n_removed"), F.col("__text").alias(text), F.col("__n").alias("n_lines"), F.col("__gone").alias("n_removed"))


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text"), lone=False)
