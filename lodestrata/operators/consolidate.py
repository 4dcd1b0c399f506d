"""Communities of files that depend on each other, their names, and the consolidation report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import components, written

#: Edges of a component up to which its communities are found in one place.
MOST_EDGES = 200_000


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node -> component (its smallest node); the number of rounds grows with the logarithm of a component's size."""
    found = components(edges.select("a", "b"), "connected").withColumnRenamed("id", "node")
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def modularity(edges: DataFrame, label: DataFrame) -> float:
    """Of a labelling (node, community) of weighted edges (a, b, weight)."""
    l = lambda c: label.select(F.col("node").alias(c), F.col("community").alias(f"c{c}"))  # noqa: E731, E741
    e = edges.join(l("a"), "a").join(l("b"), "b")
    total = e.agg(F.sum("weight")).first()[0] or 0
    if not total:
        return 0.0
    inside = e.where("ca = cb").agg(F.sum("weight")).first()[0] or 0
    degree = e.select(F.col("ca").alias("c"), "weight").unionByName(e.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    return inside / total - sum((r["d"] / (2 * total)) ** 2 for r in degree.select("d").toLocalIterator())


def _louvain(component: pd.DataFrame) -> pd.DataFrame:
    """Communities of one component: local moves in order of names, then the same on the graph of communities."""
    names = sorted(set(component["a"]) | set(component["b"]))
    place = {n: i for i, n in enumerate(names)}
    near = [dict() for _ in names]
    for a, b, w in zip(component["a"], component["b"], component["weight"]):
        near[place[a]][place[b]] = near[place[a]].get(place[b], 0) + w
        near[place[b]][place[a]] = near[place[b]].get(place[a], 0) + w
    total = sum(sum(x.values()) for x in near) / 2
    loops, of = [0.0] * len(names), list(range(len(names)))
    while True:
        n = len(near)
        degree = [sum(x.values()) + 2 * loops[i] for i, x in enumerate(near)]
        home, weight = list(range(n)), degree[:]
        moved_ever, moved = False, True
        while moved:
            moved = False
            for i in range(n):
                to = {}
                for j, w in near[i].items():
                    to[home[j]] = to.get(home[j], 0) + w
                weight[home[i]] -= degree[i]
                gain = lambda c: to.get(c, 0) - weight[c] * degree[i] / (2 * total)  # noqa: B023, E731
                best = max(sorted({*to, home[i]}), key=lambda c: (gain(c), c == home[i], -c))
                if best != home[i] and gain(best) > gain(home[i]) + 1e-12:
                    home[i], moved, moved_ever = best, True, True
                weight[home[i]] += degree[i]
        if not moved_ever:
            break
        number = {c: k for k, c in enumerate(dict.fromkeys(home))}
        of = [number[home[c]] for c in of]
        smaller, inner = [dict() for _ in number], [0.0] * len(number)
        for i in range(n):
            inner[number[home[i]]] += loops[i]
            for j, w in near[i].items():
                a, b = number[home[i]], number[home[j]]
                if a == b:
                    inner[a] += w / 2
                else:
                    smaller[a][b] = smaller[a].get(b, 0) + w
        near, loops = smaller, inner
    least = {}
    for n, c in zip(names, of):
        least.setdefault(c, n)
    return pd.DataFrame({"node": names, "community": [least[c] for c in of]})


def louvain(edges: DataFrame, nodes: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """Weighted edges (a, b, weight), nodes (node) -> node, community (its smallest node).

    A component of at most ``most_edges`` edges is worked on in one place; in larger ones, which may be most of a graph,
    communities come from label_propagation, which is never in one place.  Nodes without an edge are communities of their own.
    """
    label = connected(edges, nodes)
    own = written(edges.join(label.withColumnRenamed("node", "a"), "a").select("component", "a", "b", "weight"), "component-edges")
    large = written(own.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_edges).select("component"), "large-components")
    found = own.join(large, "component", "left_anti").groupBy("component").applyInPandas(lambda p: _louvain(p), "node string, community string")
    if not large.isEmpty():
        far = own.join(large, "component", "left_semi")
        ends = far.select(F.col("a").alias("node")).unionByName(far.select(F.col("b").alias("node")))
        found = found.unionByName(label_propagation(far, ends))
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """node -> community after so many rounds: each takes the label with most weight around it, its own counting once; ties go
    to the smallest.  Joins and aggregates only."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    label = nodes.select("node").distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "community", "weight")
        votes = votes.unionByName(label.withColumn("weight", F.lit(1).cast(votes.schema["weight"].dataType)))
        sums = votes.groupBy("node", "community").agg(F.sum("weight").alias("weight"))
        label = written(sums.groupBy("node").agg(F.min(F.struct((-F.col("weight")).alias("w"), "community")).alias("m")).select("node", F.col("m.community").alias("community")), "labels")
    return label


def common_prefix(paths: DataFrame, by: str) -> DataFrame:
    """Paths (by, path) -> by, prefix: the folders that all of a group have in common, from the root."""
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    rows = paths.select(by, folders.alias("f"))
    lows = rows.groupBy(by).agg(F.min("f").alias("x"), F.max("f").alias("y"))  # what the least and the greatest share, all share
    same = F.transform(F.arrays_zip("x", "y"), lambda p: p["x"].eqNullSafe(p["y"]) & p["x"].isNotNull())
    n = F.array_position(same, False)
    return lows.select(by, F.array_join(F.slice("x", 1, F.when(n > 0, n - 1).otherwise(F.size(same)).cast("int")), "/").alias("prefix"))


def top_symbols(members: DataFrame, defined_in: DataFrame) -> DataFrame:
    """Members (community, path) -> community, symbols: of its first 4 files the first 3 each, without repeats, 5 at most."""
    files = members.withColumn("_f", F.row_number().over(Window.partitionBy("community").orderBy("path"))).where("_f <= 4")
    own = files.join(defined_in.groupBy("path", "symbol").agg(F.min("line").alias("line")), "path")
    own = own.withColumn("_s", F.row_number().over(Window.partitionBy("community", "path").orderBy("line", "symbol"))).where("_s <= 3")
    rows = own.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("_f", "_s", "symbol"))).alias("s"))
    return rows.select("community", F.slice(F.array_distinct(F.transform("s", lambda x: x["symbol"])), 1, 5).alias("symbols"))


def subsystems(members: DataFrame, defined_in: DataFrame) -> DataFrame:
    """Members (community, path) -> subsystems: id, name by common folder, description by symbols, file_count."""
    count = members.groupBy("community").agg(F.count(F.lit(1)).alias("file_count"))
    rows = count.join(common_prefix(members, "community"), "community").join(top_symbols(members, defined_in), "community", "left")
    last = F.element_at(F.split("prefix", "/"), -1)
    name = F.when(F.length(F.coalesce(last, F.lit(""))) > 0, F.concat(F.initcap(F.regexp_replace(last, "[-_]", " ")), F.lit(" subsystem"))).otherwise(F.concat(F.lit("Subsystem "), "community"))
    text = F.concat(F.lit("Files: "), F.col("file_count").cast("string"), F.lit(". Symbols: "), F.coalesce(F.array_join("symbols", ", "), F.lit("none")))
    return rows.select(F.col("community").alias("id"), name.alias("name"), text.alias("description"), "file_count", F.current_timestamp().alias("updated_at"))
