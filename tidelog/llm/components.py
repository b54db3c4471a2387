"""Connected components of a graph of integer vertices, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.stage import Stage


def components(edges: DataFrame, stage: Stage, name: str = "components") -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b): the least vertex it is connected with.

    In each round every vertex takes the least label among its own and its neighbours', and then
    the label of that label; rounds are written to the shared folder. Neighbours' labels are
    reduced before they are shuffled, so a vertex of very many edges is no hot key. The number of
    rounds grows with the logarithm of the longest path.
    """
    both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct()
    both = stage.save(both, f"{name}-edges")
    labels = stage.save(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        # what v's neighbours say: their labels reach v over its edges
        said = both.join(labels.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("label").alias("said"))
        near = labels.join(said, "v").select("v", "label", F.least("label", "said").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("further"))
        new = near.join(jump, "next", "left").select("v", F.least("next", F.coalesce("further", "next")).alias("label"), (F.least("next", F.coalesce("further", "next")) < F.col("label")).alias("changed"))
        turn += 1
        new = stage.save(new, f"{name}-{turn}")
        going = bool(new.filter("changed").take(1))
        stage.drop(f"{name}-{turn - 1}")
        labels = new.select("v", "label")
        if not going:
            stage.drop(f"{name}-edges")
            return labels.withColumnRenamed("label", "component")
