"""Connected components of an edge table, as Spark joins.

Every round each vertex picks its smallest neighbour by a hashed priority
(or itself), and the edges are renamed by that choice, so a constant share of
the vertices vanishes a round whatever the shape of the graph. Nothing is
gathered: a hub's edges meet only in a minimum, which is taken before the
shuffle, and joins on hubs can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def _rank(c: str):
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (columns a, b, any order, repeats and loops allowed).

    ``label`` is the smallest vertex reachable. Edges with a null end are
    ignored. The result reads tables staged in the shared folder.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    live = staged(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    named = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(_rank("b")).alias("m"))
        choice = staged(best.select(F.col("a").alias("v"), F.least("m", _rank("a"))["v"].alias("p")), "choice")
        named = choice if named is None else staged(
            named.join(choice.select(F.col("v").alias("p"), F.col("p").alias("q")), "p", "left")
            .select("v", F.coalesce("q", "p").alias("p")), "named")
        nxt = (live.join(choice.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a")
               .join(choice.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
               .where(F.col("pa") != F.col("pb"))
               .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        live = staged(nxt, "edges")
    if named is None:
        return live.select(F.col("a").alias("v"), F.col("b").alias("label"))
    least = named.groupBy("p").agg(F.min("v").alias("label"))
    return named.join(least, "p").select("v", "label")
