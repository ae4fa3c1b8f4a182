"""Operator 5: exact token counts as a histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over the lengths answer
totals, quantiles and truncated totals for every context limit, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import ship


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each encoded length: n_tokens, n_docs and the suffix sums.

    ``docs_from`` and ``tokens_from`` count the documents of this length or more
    and their tokens; ``truncated_total`` is the tokens left when every document
    is cut at n_tokens. A null or empty text has length 0; repeated rows count
    each; an empty table gives no rows; only the column text is read. Rows grow
    with the number of different lengths, not with the documents.
    """
    ship(docs.sparkSession)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        found: dict[int, int] = {}
        for batch in batches:
            for _, sizes in enc.encode(batch["text"], with_ids=False):
                for n in sizes.tolist():
                    found[n] = found.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n"])

    sums = docs.select("text").mapInArrow(lengths, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))
    up = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("n_tokens"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = sums.select("n_tokens", "n_docs", F.sum("n_docs").over(up).alias("docs_from"), F.sum(tokens).over(up).alias("tokens_from"))
    total = F.sum(tokens).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("total_tokens", total)
    return out.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from"))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: documents over it, and the tokens left when documents are cut there."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    kept = F.least("n_tokens", "context_limit") * F.col("n_docs")
    long = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)
    joined = F.broadcast(asked).join(histogram, how="cross")
    return joined.groupBy("context_limit").agg(F.sum(long).alias("docs_over"), F.sum(kept).alias("truncated_total"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """Exact lower quantiles: the least length that at least this share of documents doesn't exceed."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(float(x),) for x in shares], "share double")
    n = F.max("docs_from").over(Window.partitionBy())
    up_to = histogram.withColumn("n", n).withColumn("up_to", F.col("n") - F.col("docs_from") + F.col("n_docs"))
    hit = F.when(F.col("up_to") >= F.col("share") * F.col("n"), F.col("n_tokens"))
    return F.broadcast(asked).join(up_to, how="cross").groupBy("share").agg(F.min(hit).alias("n_tokens"))
