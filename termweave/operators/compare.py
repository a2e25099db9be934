"""Sets side by side: the leading concepts of every set, and how each set stands on all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.spread import positions
from termweave.session import cut

#: Sets that a dense grid takes at most; more don't fit a table or picture that is looked at.
GRID_SETS = 1000


def leading(described: DataFrame, per_set: int = 8) -> DataFrame:
    """The per_set first significant representatives of each set; place counts from 1."""
    heads = described.where("status = 'significant' AND representative")
    return positions(heads, "set_id", [F.col("rank")], "place").where(F.col("place") <= per_set)


def comparison(described: DataFrame, per_set: int = 8) -> DataFrame:
    """(set_id, concept, label, fdr, p_value, fold, k_study, significant) of the leading labels in every set that has them.

    concept is the label's display name in the first set (by name) and place that leads with it. Of several
    rows of a set with one label the first by rank counts. The rows are sparse: a label that a set doesn't have
    has no row there; ``filled`` adds them for a bounded number of sets. Without leading concepts there are no rows.
    """
    described = cut(described)
    leads = leading(described, per_set)
    kept = leads.groupBy("label").agg(F.min(F.struct("set_id", "place", "display"))["display"].alias("named_as"))
    columns = ["fdr", "p_value", "fold", "k_study", "status"]
    first = described.join(kept, "label").groupBy("set_id", "label", "named_as").agg(F.min(F.struct("rank", *columns)).alias("x"))
    return first.select("set_id", F.col("named_as").alias("concept"), "label", "x.fdr", "x.p_value", "x.fold", "x.k_study", (F.col("x.status") == "significant").alias("significant"))


def filled(rows: DataFrame, sets: Sequence[str]) -> DataFrame:
    """``comparison`` as a full grid over the given sets: what a set doesn't have stands with fdr and p_value 1, k_study 0 and null fold.

    More than GRID_SETS sets raise ValueError.
    """
    if len(sets) > GRID_SETS:
        raise ValueError(f"a grid of {len(sets)} sets; at most {GRID_SETS} are laid out")
    named = rows.select("label", "concept").distinct().withColumn("set_id", F.explode(F.array(*map(F.lit, sets)).cast("array<string>")))
    absent = {"fdr": 1.0, "p_value": 1.0, "k_study": 0, "significant": False}
    grid = named.join(rows.drop("concept"), ["set_id", "label"], "left")
    return grid.select("set_id", "concept", "label", *[F.coalesce(c, F.lit(absent[c])).alias(c) if c in absent else F.col(c) for c in ("fdr", "p_value", "fold", "k_study", "significant")])
