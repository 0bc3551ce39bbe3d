"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _runtime as R


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``edges``; a component's name is its least node.

    Each round gives a node the name of its least neighbour, or its own if that is less, and then
    the name that this one has. The graph is contracted by these names: edges within a name are
    gone, and others are kept once. So a round meets what is left alone, stars end in one and chains
    shrink by a factor; the rounds' names, joined one after another, are the components'.

    Names are summed per task before they are shuffled, and joins are plain equi-joins that Spark
    may split, so a node with very many edges is no large task. Null ends and self-loops are ignored.
    """
    x, y = F.col(a), F.col(b)
    rest = R.written(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
    names = []
    while count := rest.count():
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select("b", "a"))
        first = ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("name"))
        above = first.select(F.col("node").alias("name"), F.col("name").alias("above"))
        names.append(R.written(R.gathered(first.join(above, "name").select("node", F.col("above").alias("name")), 2 * count), "names"))
        of = lambda end, new, known=names[-1]: known.select(F.col("node").alias(end), F.col("name").alias(new))
        met = rest.join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y")
        rest = R.written(R.gathered(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), count), "edges")
    if not names:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = names[-1].select("node", F.col("name").alias("component"))
    for known in reversed(names[:-1]):
        later = found.select(F.col("node").alias("name"), "component")
        found = R.written(R.gathered(known.join(later, "name", "left").select("node", F.coalesce("component", "name").alias("component")), known.count()), "names")
    return found
