"""Graphs of rows that are alike: connected components, and leaders in an order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged

#: Edges that a task settles at a time, about.
TASK_EDGES = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of all ends of the edges (a, b).

    Every node points at its smallest neighbour, or at itself; pointers are doubled until they end at roots, and the
    edges between roots are the next graph. Each such graph has half as many nodes at most, and pointers double in each round.
    """
    found, graph = None, edges.select("a", "b").filter("a <> b")
    while True:
        both = staged(graph.union(graph.select("b", "a")).distinct(), "both_ways")
        if not both.limit(1).count():
            break
        up = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "pointers")
        while True:
            further = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = staged(up.join(further, "p").select("a", "p", "q"), "pointers")
            done = jumped.filter("p <> q").limit(1).count() == 0
            up = jumped.select("a", F.col("q").alias("p"))
            if done:
                break
        found = up if found is None else staged(found.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("a", F.coalesce("q", "p").alias("p")), "components")
        left, right = up.select("a", F.col("p").alias("x")), up.select(F.col("a").alias("b"), F.col("p").alias("y"))
        graph = both.filter("a < b").join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b")
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return found.select(F.col("a").alias("id"), F.col("p").alias("component"))


def _settled(table: pa.Table, most: int | None) -> pa.Table:
    """id, lead of all ends of the edges (lead, place, id, other_place) of whole components, the earlier end of an edge being its lead."""
    n = table.num_rows
    places = pa.chunked_array([*table.column("place").chunks, *table.column("other_place").chunks]).combine_chunks()
    ids = pa.concat_arrays([table.column("lead").combine_chunks(), table.column("id").combine_chunks()])
    parts = pa.table({f"k{i}": c for i, c in enumerate(places.flatten())})
    order = pc.sort_indices(parts, sort_keys=[(c, "ascending") for c in parts.column_names], null_placement="at_start").to_numpy()
    code = ids.dictionary_encode()
    key = code.indices.to_numpy()
    _, first = np.unique(key[order], return_index=True)
    rank = np.empty(len(code.dictionary), np.int64)
    rank[np.argsort(first)] = np.arange(len(rank))  # nodes by their first place in the order
    lead, other = rank[key[:n]], rank[key[n:]]
    by = np.lexsort((other, lead))
    lead, other = lead[by], other[by]
    starts = np.searchsorted(lead, np.arange(len(rank) + 1)).tolist()
    leader, later = [-1] * len(rank), other.tolist()
    for i in range(len(rank)):
        if leader[i] >= 0:
            continue
        leader[i], room = i, most
        for j in later[starts[i] : starts[i + 1]]:
            if room is not None and room <= 1:
                break
            if leader[j] < 0:
                leader[j] = i
                room = None if room is None else room - 1
    at = np.argsort(rank)  # the code of each rank
    names = code.dictionary
    return pa.table({"id": names.take(pa.array(at)), "lead": names.take(pa.array(at[np.array(leader, np.int64)]))})


def _in_task(edges: DataFrame, group: Column, most: int | None) -> DataFrame:
    kind = edges.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("lead", kind)])
    target = pa.schema([(n, edges.select("id").limit(0).toArrow().schema.field("id").type) for n in ("id", "lead")])
    own = edges.select(group.alias("_group"), "lead", "place", "id", "other_place")
    return own.groupBy("_group").applyInArrow(lambda t: _settled(t, most).cast(target), schema)


def leader_clusters(nodes: DataFrame, pairs: DataFrame, order: list[Column | str], most: int | None = None) -> DataFrame:
    """id, leader: each row, in order, that no earlier leader has taken leads, and takes the rows like it that are free.

    nodes: id and what the order needs; pairs: (a, b) that are alike. A cluster has `most` members at most,
    the first in order. The order is a total one, as the id ends it.

    Components are settled whole in tasks of about TASK_EDGES edges. In a larger component the rows lead at once that have no
    open neighbour before them and whose neighbours have none either; where that settles little, as in a long
    chain, the first TASK_EDGES edges in order are settled in a task, so there are as many steps as a component has such pieces.
    """
    place = F.struct(*(c if isinstance(c, Column) else F.col(c) for c in [*order, "id"]))
    placed = staged(nodes.select("id", place.alias("place")), "nodes")
    one = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    ends = one.join(placed, "id").join(placed.select(F.col("id").alias("other"), F.col("place").alias("other_place")), "other")
    edges = staged(ends.filter("place < other_place").select(F.col("id").alias("lead"), "place", F.col("other").alias("id"), "other_place").distinct(), "edges")
    n = edges.count()
    done: list[DataFrame] = []
    if 0 < n <= TASK_EDGES:
        done.append(staged(_in_task(edges, F.lit(0), most), "settled"))
    elif n:
        known = components(edges.select(F.col("lead").alias("a"), F.col("id").alias("b")))
        each = staged(edges.join(known.select(F.col("id").alias("lead"), "component"), "lead"), "component_edges")
        large = staged(each.groupBy("component").count().filter(F.col("count") > TASK_EDGES).select("component"), "large_components")  # n / TASK_EDGES at most
        small = each.join(F.broadcast(large), "component", "left_anti")
        groups = 2 * -(-n // TASK_EDGES)
        done.append(staged(_in_task(small, F.pmod(F.xxhash64("component"), F.lit(groups)), most), "settled"))
        done += _large(staged(each.join(F.broadcast(large), "component", "left_semi").drop("component"), "edges"), most)
    named = placed.select("id")
    if not done:
        return named.withColumn("leader", F.col("id"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return named.join(every, "id", "left").select("id", F.coalesce("lead", "id").alias("leader"))


def _large(edges: DataFrame, most: int | None) -> list[DataFrame]:
    """id, lead of the ends of edges that no task takes whole."""
    done, n = [], edges.count()
    while n:
        first = edges.groupBy("id").agg(F.min("place").alias("first"))
        waiting = edges.join(first, "id").filter("place > first").select(F.col("lead").alias("id"))
        ready = edges.select(F.col("lead").alias("id")).distinct().join(waiting.union(edges.select("id")).distinct(), "id", "left_anti")
        taken = edges.join(ready.select(F.col("id").alias("lead")), "lead", "left_semi")
        if most is not None:
            rank = F.row_number().over(Window.partitionBy("lead").orderBy("other_place"))
            taken = taken.withColumn("_rank", rank).filter(F.col("_rank") < most)
        settled = staged(taken.select("id", "lead").union(ready.select("id", F.col("id").alias("lead"))), "settled")
        done.append(settled)
        edges, left = _without(edges, settled)
        if most is None and left > n // 2:
            edges, left = _first_piece(edges, done)
        n = left
    return done


def _without(edges: DataFrame, settled: DataFrame) -> tuple[DataFrame, int]:
    gone = settled.select("id")
    left = edges.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("lead")), "lead", "left_anti")
    left = staged(left.select("lead", "place", "id", "other_place"), "edges")
    return left, left.count()


def _first_piece(edges: DataFrame, done: list[DataFrame]) -> tuple[DataFrame, int]:
    """Settle the nodes up to a place that about TASK_EDGES edges end before, and the later ones that they take."""
    cut = edges.orderBy("other_place").limit(TASK_EDGES).agg(F.max("other_place").alias("cut"))
    marked = edges.join(F.broadcast(cut)).withColumns({"early": F.col("place") <= F.col("cut"), "inner": F.col("other_place") <= F.col("cut")})
    inner = _in_task(marked.filter("inner"), F.lit(0), None)
    alone = marked.filter("early").select(F.col("lead").alias("id")).distinct().join(marked.filter("inner").select(F.explode(F.array("lead", "id")).alias("id")).distinct(), "id", "left_anti")
    whole = staged(inner.unionByName(alone.select("id", F.col("id").alias("lead"))), "settled")
    done.append(whole)
    leads = whole.filter("id = lead").select("lead")
    later = marked.filter("early and not inner").join(leads, "lead", "left_semi").groupBy("id").agg(F.min_by("lead", "place").alias("lead"))
    later = staged(later, "settled")
    done.append(later)
    edges, _ = _without(edges, whole)
    return _without(edges, later)
