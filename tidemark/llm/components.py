"""Connected components of a graph by contraction: each round joins nodes, and edges within a joined node are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of edges(a long, b long); loops and nulls are left out.

    In each round a node goes over to the neighbour that a hash of the round and the node puts first, or stays. Edges
    are then renamed, those within one node and repeated ones are dropped, and the next round has only the rest: every
    node with an edge joins another or is joined, so few rounds are left even for a chain. Neighbours' hashes are
    combined before they are shuffled, so a hub costs no more.
    """
    live = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        place = lambda c, n=len(moves): F.struct(F.xxhash64(F.lit(n), c).alias("place"), F.col(c).alias("to"))
        both = live.union(live.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("first"))
        moves.append(written(both.select("node", F.least(place("node"), "first")["to"].alias("to")), "cc-moves"))
        for end in ("a", "b"):
            live = live.join(moves[-1].select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        live = live.filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        live = written(live, "cc-edges")
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # A node is where it went to last; rounds have ever fewer nodes, so they are followed from the last to the first.
    last = moves[-1]
    for move in reversed(moves[:-1]):
        later = last.select(F.col("node").alias("to"), F.col("to").alias("end"))
        last = move.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    last = written(last, "cc-ends")
    return last.join(last.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")
