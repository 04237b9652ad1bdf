"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.sources.tables import materialize


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    return (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u > v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``u``, ``v``) that is not the smallest of its component.

    Each round hangs every node below its smallest neighbour, follows these links to their
    ends (each step doubles their reach) and contracts the edges to the ends. Only nodes
    without a smaller neighbour are left, at most half of those with edges, so the rounds
    are a logarithm of the nodes. Every table between two steps is written.
    """
    edges = materialize(_pairs(edges, "u", "v"), "edges")
    labels = None
    while not edges.isEmpty():
        links = materialize(edges.groupBy("u").agg(F.min("v").alias("to")), "links")
        while True:
            far = links.select(F.col("u").alias("via"), F.col("to").alias("far"))
            links = materialize(
                links.select("u", "to")
                .join(far, F.col("to") == F.col("via"), "left")
                .select("u", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")),
                "links",
            )
            if links.filter("moved").isEmpty():
                break
        links = links.select("u", "to")
        first, second = (links.select(F.col("u").alias(f"{x}0"), F.col("to").alias(f"{x}1")) for x in "ab")
        edges = materialize(
            _pairs(
                edges.join(first, F.col("u") == F.col("a0"), "left")
                .join(second, F.col("v") == F.col("b0"), "left")
                .select(F.coalesce("a1", "u").alias("x"), F.coalesce("b1", "v").alias("y")),
                "x",
                "y",
            ),
            "edges",
        )
        if labels is None:
            labels = links
        else:
            later = links.select(F.col("u").alias("via"), F.col("to").alias("far"))
            labels = (
                labels.join(later, F.col("to") == F.col("via"), "left")
                .select("u", F.coalesce("far", "to").alias("to"))
                .unionByName(links)
            )
            labels = materialize(labels, "labels")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels.select(F.col("u").alias("node"), F.col("to").alias("root"))
