"""Operator 2: mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size of the source. In a fixed
order the prefix sums of the expected copies, plus one random offset a source, cross integers; a document is
emitted once for each integer that its step crosses. Whole documents are taken, 0 to 2 times.

All of it is DataFrame operations. Texts are read once, to count words; what is shuffled is a narrow table.
A source is cut into as many blocks of documents (by a hash of the id) as its number of documents asks for, so
that no task holds a whole source: the order is by block, then by size within a block, and blocks carry on their
predecessors' prefix sum.

Defined cases: null and empty texts have size 0 and count as documents; null sources are one source, ranked
last; repeated rows are separate documents; a null doc_id is ordered as 0; an empty table gives no rows; a
source of size 0 has target 0. Only the id, text and source columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import WORD, fresh, materialise, row_key, text_or_empty

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: All sources together get this share of all words; one gets `MOST` times its size at most.
SHARE, MOST = 1.5, 2
#: Documents in a block, about.
BLOCK = 2048
#: Of the generator x -> x * A mod P that orders documents and makes offsets.
A, P = 48271, 2147483647


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, the row's key and h, a fixed pseudo-random number of the id."""
    h = F.pmod(F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(P)) * A + 12345, F.lit(P))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), row_key(id_col, text_col).alias("key")).withColumn("h", h)


def targets(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: docs, source_size, target, offset.

    The level at which weights are served rises until the shares are spent; a source stops at `most` times
    its size. Sources in order of (limit / weight) fill up first, so one pass of prefix sums finds the level.
    """
    s = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))) + 1))
    s = s.withColumn("most", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    level = (F.col("total") - F.coalesce(F.sum("most").over(up), F.lit(0.0))) / F.sum("weight").over(on)
    s = s.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    offset = F.pmod((F.col("rank").cast("long") + 1) * 1000003 % P * A, F.lit(P)) / F.lit(float(P))
    return s.select("source", "docs", "source_size", F.least("most", F.col("weight") * found).alias("target"), offset.alias("offset"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, key: how often the mix takes each document."""
    narrow = materialise(sizes(docs, id_col, text_col, source_col), "mixing")
    by_source = targets(narrow, weights, share, most)
    of = by_source.select(F.col("source").alias("of"), "source_size", "target", "offset", F.greatest(F.lit(1), F.ceil(F.col("docs") / block)).cast("long").alias("blocks"))
    dealt = narrow.join(of, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod("h", "blocks"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("of"), F.col("block").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("source", "block").orderBy("size", "h", "doc_id"))
    # the starts hold a row for each source and block: rows / 2048 + sources
    placed = dealt.withColumn("place", place).join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in"))).withColumn("place", F.col("start") + F.col("place"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("place") * rate + F.col("offset")) - F.floor((F.col("place") - 1) * rate + F.col("offset"))
    return placed.select("doc_id", "source", "size", "source_size", "target", crossed.cast("int").alias("copies"), "key")


def mixed_documents(docs: DataFrame, **columns: str) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as it is taken.

    Rows that are copies in id and text are one row, taken as often as they are together.
    """
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    key, copies, rows, copy = fresh(docs, "mix_key", "mix_copies", "mix_rows", "mix_copy")
    taken = mix(docs, **columns).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(taken.filter(F.col(copies) > 0), key)
    one = joined.filter(F.col(rows) == 1).unionByName(joined.filter(F.col(rows) > 1).dropDuplicates([key]))
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
