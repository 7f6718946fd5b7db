"""Connected components of an edge table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsengine.llm.frames import cut


def components(edges: DataFrame, labels: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """(id, comp) for every id of ``edges`` (a, b); comp is the least id of the component.

    With ``labels`` (id, comp) of earlier edges, those are contracted first:
    only edges between different components are walked again, and the result
    holds the ids of both. Each round takes the least label among the
    neighbours and then follows labels once, so their paths halve. Every round
    is written to the shared checkpoint folder; only a count of changes reaches
    the driver. Repeated edges and loops change nothing, ids are not null, and
    no edges give no rows.
    """
    if labels is not None:
        return contracted(edges, labels, most_rounds)
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = moved.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        new = cut(moved.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        changed = new.where("old <> comp").limit(1).count()
        labels = new.select("id", "comp")
        if not changed:
            return labels
    raise RuntimeError("the components did not settle")


def contracted(edges: DataFrame, labels: DataFrame, most_rounds: int) -> DataFrame:
    """``labels`` after ``edges`` have joined components of them."""
    end = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))
    ends = cut(edges.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left").select("a", "b", F.coalesce("comp_a", "a").alias("x"), F.coalesce("comp_b", "b").alias("y")))
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), None, most_rounds)
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("x").alias("comp")), F.struct(F.col("b").alias("id"), F.col("y").alias("comp")))).alias("e")).select("e.*")
    every = labels.union(new).distinct()
    return cut(every.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("least")), "comp", "left").select("id", F.coalesce("least", "comp").alias("comp")))
