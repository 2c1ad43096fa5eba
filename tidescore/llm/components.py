"""Connected components of a graph that is too large for one machine, by contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescore.llm.common import delete, folder, store


def components(edges: DataFrame) -> DataFrame:
    """From edges ``a, b`` (bigint) to ``id, component``: the smallest id that each id is connected with.

    In a round, every vertex is mapped to the first of its neighbours and itself, and the edges are mapped with
    it; what becomes a loop or a copy goes. The order is by id in the first round, where stars collapse at once,
    and then by a hash that changes with the round, so that long chains shrink by a constant share as well. The
    maps of all rounds are then composed. Minima combine before the shuffle, and the joins are between stored
    tables, so that adaptive execution can split a vertex with very many edges. Nothing but the sign that no edge
    is left comes to the driver. Edges with a null end and loops are ignored; an empty input gives no rows.
    """
    spark, base = edges.sparkSession, folder(edges.sparkSession, "components")
    a, b = F.col("a"), F.col("b")
    pairs = store(edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
                  f"{base}/pairs_0")
    maps: list[DataFrame] = []
    while not pairs.isEmpty():
        turn = len(maps)
        both = pairs.select(a.alias("u"), b.alias("v")).unionAll(pairs.select(b, a))
        first = both.groupBy("u").agg(F.min_by("v", _order("v", turn)).alias("v"))
        moved = F.when(_order("v", turn) < _order("u", turn), F.col("v")).otherwise(F.col("u"))
        maps.append(store(first.select("u", moved.alias("to")), f"{base}/map_{turn}"))
        at_a, at_b = maps[-1].toDF("a", "to_a"), maps[-1].toDF("b", "to_b")
        ends = pairs.join(at_a, "a").join(at_b, "b").filter("to_a <> to_b")
        pairs = store(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
                      f"{base}/pairs_{turn + 1}")
        delete(spark, f"{base}/pairs_{turn}")
    if not maps:
        delete(spark, base)
        return spark.createDataFrame([], "id bigint, component bigint")
    found = maps[0]
    for later in maps[1:]:
        found = found.join(later.toDF("to", "next"), "to", "left").select("u", F.coalesce("next", "to").alias("to"))
    found = store(found, f"{base}/found")
    smallest = store(found.groupBy("to").agg(F.min("u").alias("component")), f"{base}/smallest")
    named = found.join(smallest, "to").select(F.col("u").alias("id"), "component")
    result = store(named, folder(spark, "connected"))
    delete(spark, base)
    return result


def _order(column: str, turn: int) -> Column:
    return F.col(column) if turn == 0 else F.xxhash64(F.lit(turn), column)
