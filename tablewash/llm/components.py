"""Connected components of a link table, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.llm.common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a long, b long); a component is named by its smallest node.

    Each round every node is merged with its smallest neighbour, all along the
    trees that this gives, and the links are drawn anew between what is left, each once, so that later rounds see
    few of them. A round is written to the shared folder before the next. Links
    may repeat; links of a node with itself and null ends are dropped. No links
    give no rows.
    """
    clean = links.filter("a <> b").select("a", "b")
    both = checkpointed(clean.union(clean.select("b", "a")).distinct())
    names = both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while both.limit(1).count():
        into = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).select(F.col("a").alias("x"), "to")
        into = checkpointed(into)
        # Nodes that point to smaller ones form trees: follow the pointers, twice as far each time, to the roots.
        while True:
            further = into.select(F.col("x").alias("y"), F.col("to").alias("next"))
            into = checkpointed(into.join(further, F.col("to") == F.col("y")).select("x", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")))
            if not into.filter("moved").limit(1).count():
                break
        names = names.join(into, F.col("component") == F.col("x"), "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
        names = checkpointed(names)
        left = both.filter("a < b").join(into, F.col("a") == F.col("x")).select(F.col("to").alias("a"), "b")
        left = left.join(into, F.col("b") == F.col("x")).select("a", F.col("to").alias("b")).filter("a <> b").distinct()
        both = checkpointed(left.union(left.select("b", "a")).distinct())
    return names
