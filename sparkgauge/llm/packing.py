"""Packing: optimal length buckets by dynamic programming, and token-budget batches inside each.

The token lengths of all documents are counted in one global histogram: a row for each distinct length, however many
documents there are. Dynamic programming over it chooses at most K bucket lengths that minimise padding; as the cost of a
bucket is linear in the counts before it, a step over n lengths takes n moves on a hull of lines, in whole numbers. Inside a
bucket, documents in doc_id order form batches of floor(budget / bucket length) documents, at least one. Ranks are taken by
ranges (ranks.py), so one bucket may hold all rows, and ids may be dense or sparse.

Tokens are words between white space. Null and empty texts: no tokens, in the first bucket (its length is at least 1). Long
texts: a document over the budget is a batch of its own. Ties and repeated rows keep a place each (order: doc_id, then length).
Null doc_id: as the smallest. Empty table: no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranks import row_numbers
from .common import cut

BUCKETS, BUDGET = 16, 65_536


def token_count(text: Column) -> Column:
    """White-space separated words."""
    trimmed = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " +"))).cast("long")


def best_boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least padding in all. Lengths ascend. Of equal
    plans the one with fewer buckets, then with smaller boundaries from the top down."""
    n = len(lengths)
    if not n:
        return []
    many, total = [0], [0]
    for x, c in zip(lengths, counts, strict=True):
        many.append(many[-1] + c)
        total.append(total[-1] + c * x)
    # After one bucket, and then one more each time: best[j] for the first j lengths, from the last bucket's start i < j:
    # x_j (many_j - many_i) - (total_j - total_i) + before_i, a line in x_j of slope -many_i and height before_i + total_i.
    best = [0] + [x * many[j] - total[j] for j, x in enumerate(lengths, 1)]
    choice, costs = [[0] * (n + 1)], [best[n]]
    for k in range(1, min(buckets, n)):
        hull: list[int] = []
        new, pick, at = best[: k + 1], [0] * (n + 1), 0
        height = [b + t for b, t in zip(best, total, strict=True)]
        for j in range(k + 1, n + 1):
            i = j - 1  # the newest line; slopes descend, so it is the last of the hull
            while len(hull) > 1:
                a, b = hull[-2], hull[-1]
                if (height[i] - height[a]) * (many[b] - many[a]) > (height[b] - height[a]) * (many[i] - many[a]):
                    break
                hull.pop()
            hull.append(i)
            at, x = min(at, len(hull) - 1), lengths[j - 1]
            while at + 1 < len(hull) and height[hull[at + 1]] - x * many[hull[at + 1]] < height[hull[at]] - x * many[hull[at]]:
                at += 1
            pick[j] = hull[at]
            new.append(x * many[j] - total[j] + height[hull[at]] - x * many[hull[at]])
        best = new
        choice.append(pick)
        costs.append(best[n])
    k, j, ends = costs.index(min(costs)), n, []
    while j:
        ends.append(lengths[j - 1])
        j = choice[k][j]
        k -= 1
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot, padding of each document."""
    sized = cut(docs.select(F.col("doc_id").cast("long"), token_count(F.col("text")).alias("n_tokens")), "lengths")
    histogram = sized.groupBy(F.greatest("n_tokens", F.lit(1)).alias("len")).count().orderBy("len").collect()  # a row for each distinct length
    ends = best_boundaries([r["len"] for r in histogram], [r["count"] for r in histogram], buckets) or [1]
    edges = F.array(*[F.lit(e) for e in ends])
    placed = sized.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("n_tokens"))).cast("int"))
    ranked = row_numbers(placed, [F.col("doc_id").asc_nulls_first(), F.col("n_tokens")], ["bucket"], "rank")
    length = F.get(edges, F.col("bucket")).cast("long")
    room = F.greatest(F.floor(F.lit(budget) / length), F.lit(1)).cast("long")
    return ranked.select(
        "doc_id", "n_tokens", "bucket", length.alias("bucket_len"), F.floor(F.col("rank") / room).cast("long").alias("batch"),
        (F.col("rank") % room).cast("long").alias("slot"), (length - F.col("n_tokens")).alias("padding"),
    )
