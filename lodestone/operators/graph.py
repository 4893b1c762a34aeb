"""Link graph: edges, PageRank, incoming links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def edges_of(pages: DataFrame, key: str = "url", links: str = "outgoing_links") -> DataFrame:
    """(src, dst, w) of all links, repeats and outside targets too; w is one over the page's links."""
    out = pages.select(F.col(key).alias("src"), F.col(links).alias("l")).where(F.size("l") > 0)
    return out.select("src", (1 / F.size("l")).alias("w"), F.explode("l").alias("dst"))


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes, their weights as given; several between the same nodes add up."""
    names = nodes.select("node")
    kept = edges.join(names.withColumnRenamed("node", "dst"), "dst", "left_semi").join(names.withColumnRenamed("node", "src"), "src", "left_semi")
    return kept.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def member_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes by membership: a target counts once however often a page links to it, with the
    weight of one of its links, that is one over all links of the page."""
    return known_edges(edges.dropDuplicates(["src", "dst"]), nodes)


#: Nodes from which on a round's tables are joined by shuffle: broadcast ones pass through the driver in every round.
BROADCAST_NODES = 20_000


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, normalise: bool = False, members: bool = False, each: bool = False, every: int = 5) -> DataFrame:
    """(node, rank) by power iteration, without redistribution of what leaves the graph.

    Each round joins edges with ranks on the source and sums by target; partial sums take hot targets. Every
    ``every`` rounds the ranks are written to shared storage, which bounds the plan. With a tolerance the
    rounds end once the ranks' total change (with ``each``, every node's change) is below it, and the ranks
    before that round are returned. With ``members`` repeated links count once. Ranks of over BROADCAST_NODES nodes
    are never broadcast, so the driver gets a number a round, whatever the planner's threshold.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    held = materialise((member_edges if members else known_edges)(edges, nodes), "edges")
    ranks = materialise(nodes.select("node", F.lit(1.0 / n).alias("rank")), "ranks")
    base = (1 - damping) / n
    dealt = (lambda df: df.hint("merge")) if n > BROADCAST_NODES else lambda df: df
    for i in range(rounds):
        flow = held.join(dealt(ranks), held["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("in"))
        new = ranks.select("node", F.col("rank").alias("was")).join(dealt(flow), F.col("node") == F.col("dst"), "left").select("node", "was", (F.lit(base) + F.lit(damping) * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if normalise:
            new = materialise(new, "flow")  # read twice
            total = new.agg(F.sum("rank").alias("total"))
            new = new.crossJoin(F.broadcast(total)).select("node", "was", (F.col("rank") / F.col("total")).alias("rank"))
        if tolerance is not None or (i + 1) % every == 0:
            new = materialise(new, "ranks")
        if tolerance is not None and new.agg((F.max if each else F.sum)(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance:
            break
        ranks = new.select("node", "rank")
    return ranks


def rank_statistics(ranks: DataFrame) -> DataFrame:
    """One row: total, least, greatest, mean and median rank."""
    return ranks.agg(*[F.round(f("rank"), 9).alias(n) for n, f in (("total", F.sum), ("least", F.min), ("greatest", F.max), ("mean", F.avg))], F.round(F.expr("percentile(rank, 0.5)"), 9).alias("median"))


def incoming_counts(links: Column, pages: DataFrame) -> DataFrame:
    """(url, incoming_count) over all links; empty ones are none."""
    return pages.select(F.explode(links).alias("url")).where("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("incoming_count"))


def with_column_if_absent(df: DataFrame, name: str, kind: str = "double") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def update_by_key(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``df`` with ``column`` as in ``changes`` where that has the key."""
    new = changes.select(key, F.col(column).alias("_new"))
    old = with_column_if_absent(df, column, dict(changes.dtypes)[column])
    return old.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*old.columns)
