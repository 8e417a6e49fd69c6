"""Connected components of a link table, by label passing and pointer jumping.

Every round joins the links with the current labels, takes the smallest label
among neighbours and jumps to the label's own label. Rounds are written to the
shared folder; nothing but a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

#: Steps between two writes of the labels.
STEPS = 2


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable, for each id in links (a, b: long)."""
    both = written(links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label"))
    while True:
        new = labels
        for _ in range(STEPS):
            near = both.join(new.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
            # the label's own label, asked once for each label in use
            lifted = new.select(F.col("id").alias("label"), F.col("label").alias("above"))
            kept = [] if new is labels else ["moved"]
            moved = new.join(lifted, "label", "left").join(near, "id", "left")
            change = F.least("above", "near") < F.col("label")
            new = moved.select("id", F.least("label", "above", "near").alias("label"), (change | F.col("moved") if kept else change).alias("moved"))
        new = written(new)
        changed = new.where("moved").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels
