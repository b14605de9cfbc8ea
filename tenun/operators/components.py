"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenun.sources.shared import Workspace, files_for


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a small table at once: the smallest label moves along them until nothing changes."""
    given = [b for b in batches if b.num_rows]
    if not given:
        return
    table = pa.Table.from_batches(given)
    ends = [table.column(c).to_pandas().to_numpy() for c in ("a", "b")]
    nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
    one, two = places[: len(ends[0])], places[len(ends[0]) :]
    label = np.arange(len(nodes))
    while True:
        # a link hooks the larger label to the smaller one, then all labels point to themselves again
        low, high = np.minimum(label[one], label[two]), np.maximum(label[one], label[two])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    kind = given[0].schema.field("a").type
    for at in range(0, len(nodes), 10_000):
        part = slice(at, at + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[part].tolist(), kind), pa.array(nodes[label[part]].tolist(), kind)], ["node", "component"])


def connected_components(edges: DataFrame, src: str, dst: str, files: int | None = None, last: int = 0) -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Returns ``(node, component)``, one row per node that has an edge to another
    node; self-loops and null ends are ignored. Each round hooks every node to
    its smallest neighbour, jumps pointers until all trees are flat, and
    contracts the edges to the roots. At least half of the remaining nodes
    disappear each round, so long chains take logarithmically many rounds, and
    no round brings a component together in one task: all steps are partial
    aggregations and equi-joins. ``files`` is how many files the working tables
    are written to, by default as many as the number of links asks for. Once ``last``
    links or fewer are left, they are followed in one task, which saves the rounds' tables.
    """
    work = Workspace(edges.sparkSession, "components")
    rest = work.save(_ordered(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))), "edges-0", files)
    files = files or files_for(rest.count())
    labels = None
    step = 0
    while n := rest.count():
        step += 1
        if n <= last:
            kind = f"node {rest.schema['a'].dataType.simpleString()}, component {rest.schema['a'].dataType.simpleString()}"
            found = rest.select("a", "b").coalesce(1).mapInArrow(_labels, kind)
            if labels is not None:
                found = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            labels = work.save(found, f"labels-{step}", files)
            break
        ways = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hop = ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        hop = work.save(hop.select("node", F.least("node", "near").alias("up")), f"hop-{step}-0", files)
        jump = 0
        while True:
            # two jumps a round: half the tables to write
            over = hop.select(F.col("node").alias("up"), F.col("up").alias("far"))
            farther = hop.select(F.col("node").alias("far"), F.col("up").alias("farther"))
            wide = hop.join(over, "up").join(farther, "far").select("node", F.col("farther").alias("up"), (F.col("farther") != F.col("up")).alias("moved"))
            jump += 1
            wide = work.save(wide, f"hop-{step}-{jump}", files)
            hop = wide.select("node", "up")
            if wide.where("moved").isEmpty():
                break
        heads = hop.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        tails = hop.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        rest = rest.join(heads, "a").join(tails, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        rest = work.save(_ordered(rest), f"edges-{step}", files)
        if labels is None:
            labels = hop.select("node", F.col("up").alias("component"))
        else:
            moved = hop.select(F.col("node").alias("component"), "up")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = work.save(labels, f"labels-{step}", files)
    if labels is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    work.keep(f"labels-{step}")
    return labels


def extend_components(labels: DataFrame, edges: DataFrame, src: str, dst: str, last: int = 0) -> tuple[DataFrame, DataFrame]:
    """What new ``edges`` change: ``(node, component)`` of nodes without a label, and ``(component, merged)`` of components that are joined to others.

    ``labels`` is ``(node, component)`` of all earlier edges, each component named by its
    smallest node. Only the ends of the new edges are looked up in it; links between
    known components are links between their names, so what is followed is as large
    as the new edges, not as all there are. Both results together with ``labels`` are the
    components of old and new edges.
    """
    work = Workspace(edges.sparkSession, "extend")
    links = work.save(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b"), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = work.save(ends.join(labels.select("node", "component"), "node", "left"), "known")
    name = lambda end: known.select(F.col("node").alias(end), F.coalesce("component", "node").alias(f"{end}_name"))
    contracted = links.join(name("a"), "a").join(name("b"), "b").select("a_name", "b_name")
    found = work.save(connected_components(contracted, "a_name", "b_name", last=last), "found")
    merged = found.join(known.where("component is not null").select(F.col("component").alias("node")).distinct(), "node", "left_semi").where("node <> component").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    fresh = known.where("component is null").select("node").join(found, "node").select("node", "component")
    return fresh, merged


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, smaller end first, without self-loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
