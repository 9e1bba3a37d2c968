"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph
from .common import discard, materialize


def components(links: DataFrame, scope: str = "lakeloom") -> DataFrame:
    """``node, root``: the smallest node that each linked node (long columns ``a``, ``b``) can reach.

    Each round's links are written to the shared folder, so a lost executor costs one round; those of the
    round before go then. Nodes with no link but to themselves are their own root; null ends are ignored.
    """
    ends = materialize(links.select("a", "b").where("a is not null and b is not null").distinct(), scope)
    rounds: list[DataFrame] = []

    def cut(df: DataFrame) -> DataFrame:
        rounds.append(materialize(df, scope))
        discard(*rounds[:-1])
        del rounds[:-1]
        return rounds[0]

    return graph.components(ends, cut).withColumnRenamed("component", "root")
