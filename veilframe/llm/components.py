"""Connected components by minimum label: hooking of roots and pointer jumping, a few small joins a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_table, stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); a component is named by its smallest node.

    Every table is written before it is joined, so that each join shuffles both sides by the key alone
    and adaptive execution can split a hub's rows.  Null ends, loops and repeated edges are allowed; no edges give no rows.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = stage_table(both.select("a", "b").union(both.select("b", "a")).distinct(), "edges")
    labels = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "labels")
    state = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)")))
    before = state.first()
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("to").alias("low"))
        best = labels.join(seen, labels.node == seen.a).select("node", "to", F.least("to", "low").alias("low"))
        both_hooks = F.array(F.struct("node", F.col("low").alias("new")), F.struct(F.col("to").alias("node"), F.col("low").alias("new")))
        hooked = stage_table(best.select(F.inline(both_hooks)).groupBy("node").agg(F.min("new").alias("to")), "hooked")
        parent = hooked.select(F.col("node").alias("p"), F.col("to").alias("up"))
        jumped = stage_table(hooked.join(parent, F.col("to") == F.col("p")).select("node", F.col("up").alias("to")), "jumped")
        after = jumped.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        for t in (labels, hooked):
            drop_table(t)
        labels = jumped
        if after == before:  # a round changed no label
            drop_table(both)
            out = labels.select("node", F.col("to").alias("component"))
            out._veil_path = labels._veil_path
            return out
        before = after
