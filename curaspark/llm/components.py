"""Connected components of a table of links, by alternating large and small stars.

Each round is a grouped minimum and a join per star, so that a node with many
links is aggregated before the shuffle and salted in the join; rounds are written
to the shared folder to cut the lineage.  The number of rounds is logarithmic in a component's
diameter.  Before the rounds, each task replaces the links it reads, up to EDGES at a
time, by one link from each node to the least it reaches by them; if no more than EDGES
are left, one task does the same with all of them and there are no rounds.  Nothing but
counters reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import shared


SALTS = 8
EDGES = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1, the least that it reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def contract(links: DataFrame) -> DataFrame:
    """u, v of fewer links that join the same nodes: those of EDGES rows of a task at a time become links to the least node."""
    a, b = links.columns
    kind = links.schema[a].dataType

    def run(batches):
        def forest(held):
            ends = [x.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b") for x in held]
            nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
            root = least_reached(*at.reshape(2, -1), len(nodes))
            moved = root != np.arange(len(nodes))
            columns = [pa.array(x, held[0].schema.field("a").type) for x in (nodes[moved], nodes[root[moved]])]
            return pa.RecordBatch.from_arrays(columns, ["u", "v"])

        held = []
        for rows in batches:
            held.append(rows)
            if sum(x.num_rows for x in held) >= EDGES:
                yield forest(held)
                held = []
        if held:
            yield forest(held)

    return shared.map_arrow(links.filter(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b")), run, StructType([StructField("u", kind), StructField("v", kind)]))


def _star(links: DataFrame) -> DataFrame:
    """u, v -> m, v: every neighbour of u (and u) pointed at the least of them."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # a node with very many links is spread over SALTS tasks; its one least goes to each of them
    salted = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return links.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "_salt"]).select("u", "v", "m")


def components(links: DataFrame, most_rounds: int = 60, in_task: int = EDGES) -> DataFrame:
    """``links``: a, b (any order, repeats allowed). Returns node, component (its least node); linked nodes only.

    in_task: links, EDGES at most, that one task may finish without rounds.
    """
    edges = shared.spill(contract(links), "links")
    state = lambda: tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state()
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    whole = before[0] <= min(in_task, EDGES)
    if whole:
        edges = shared.spill(contract(edges.coalesce(1)), "links")
    for _ in range(0 if whole else most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large.select("u", "v"))
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = shared.spill(edges, "round")
        now = state()
        if before == now:
            break
        before = now
    else:
        if not whole:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
