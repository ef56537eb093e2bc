"""Connected components of links, as labels of all nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import roots
from .common import cut, discard


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): label is the smallest id that links reach. nodes(id), links(a, b) between nodes, either way round."""
    found = roots(links)
    up = found.select(F.col("id").alias("of"), "root")
    ids = nodes.select("id").distinct()
    labels = cut(ids.join(up, ids.id == up.of, "left").select("id", F.coalesce("root", "id").alias("label")), "labels")
    discard(found)
    return labels
