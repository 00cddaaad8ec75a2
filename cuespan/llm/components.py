"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (id, comp) for each end of a link; comp is the least id that links reach.

    Each round, a vertex takes the least id among itself and its neighbours, pointers are followed to their
    ends, and the graph is contracted to those: at most half the vertices that have links stay.
    All tables are written to the shared folder; counts alone come to the driver.
    """
    e = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "links")
    labels = None
    while not e.isEmpty():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = stored(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("to")), "step")
        while True:  # a pointer's own pointer, until none leads on
            hop = step.select(F.col("u").alias("to"), F.col("to").alias("next"))
            step = stored(step.join(hop, "to").select("u", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "hop")
            if step.where("moved").isEmpty():
                break
        if labels is None:
            labels = step.select(F.col("u").alias("id"), F.col("to").alias("comp"))
        else:
            labels = labels.join(step.withColumnRenamed("u", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
        labels = stored(labels, "labels")
        e = e.join(step, "u").select(F.col("to").alias("u"), "v").join(step.select(F.col("u").alias("v"), F.col("to").alias("w")), "v")
        e = stored(e.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("v")).where("u <> v").distinct(), "links")
    if labels is None:
        return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return labels
