"""Co-occurrence networks of entities in containers, and measures on small graphs.

Edges come of a self-join on the container, which is bounded by its size (a sentence, a
paragraph, an order).  Degree, strength and the choice of nodes stay in Spark; the other
measures run on the driver, on the at most ``max_nodes`` strongest nodes."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(occurrences: DataFrame, entity: str = "entity", container: str = "container", min_weight: int = 1) -> DataFrame:
    """(a, b, weight) with a < b: in how many containers both occur."""
    once = occurrences.select(container, entity).where(F.col(entity).isNotNull()).distinct()
    left, right = once.select(container, F.col(entity).alias("a")), once.select(container, F.col(entity).alias("b"))
    pairs = left.join(right, container).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_weight)


def degrees(edges_: DataFrame) -> DataFrame:
    ends = edges_.select(F.explode(F.array("a", "b")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def strongest(edges_: DataFrame, max_nodes: int) -> DataFrame:
    """The edges among the strongest nodes (ties to the smaller id)."""
    top = degrees(edges_).orderBy(F.col("strength").desc(), "node").limit(max_nodes)
    kept = edges_.join(top.select(F.col("node").alias("a")), "a", "left_semi")
    return kept.join(top.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "weight")


def neighbours(edges_: DataFrame, focus, top: int = 20) -> DataFrame:
    """Whom a node occurs with most."""
    other = F.when(F.col("a") == focus, F.col("b")).otherwise(F.col("a"))
    return edges_.where((F.col("a") == focus) | (F.col("b") == focus)).select(other.alias("node"), "weight").orderBy(F.col("weight").desc(), "node").limit(top)


def measures(edge_rows: list[tuple], most: int = 1000) -> dict:
    """Measures of a small undirected graph: per node degree, strength, betweenness and closeness
    with 1/weight as length, eigenvector centrality, weighted clustering and component; and density."""
    near: dict = {}
    for a, b, w in edge_rows:
        near.setdefault(a, {})[b] = float(w)
        near.setdefault(b, {})[a] = float(w)
    nodes = sorted(near)
    if len(nodes) > most:
        raise ValueError(f"{len(nodes)} nodes; choose at most {most} with strongest()")
    n = len(nodes)
    out = {v: {"degree": len(near[v]), "strength": sum(near[v].values()), "betweenness": 0.0} for v in nodes}
    for s in nodes:
        length, paths, before, order, heap = {s: 0.0}, dict.fromkeys(nodes, 0.0), {v: [] for v in nodes}, [], [(0.0, s)]
        paths[s], done = 1.0, set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u, w in near[v].items():
                far = d + 1 / w
                if u not in length or far < length[u] - 1e-12:
                    length[u], paths[u], before[u] = far, paths[v], [v]
                    heapq.heappush(heap, (far, u))
                elif abs(far - length[u]) <= 1e-12 and u not in done:
                    paths[u] += paths[v]
                    before[u].append(v)
        total = sum(length.values())
        reach = len(length) - 1
        out[s]["closeness"] = reach / total * reach / (n - 1) if total else 0.0
        out[s]["component"] = min(length)
        owed = dict.fromkeys(nodes, 0.0)
        for v in reversed(order):
            for u in before[v]:
                owed[u] += paths[u] / paths[v] * (1 + owed[v])
            if v != s:
                out[v]["betweenness"] += owed[v] / 2
    scale = (n - 1) * (n - 2) / 2
    heaviest = max((w for v in near.values() for w in v.values()), default=1.0)
    vector = dict.fromkeys(nodes, 1.0)
    for _ in range(200):  # shifted power iteration, which also settles on bipartite graphs
        new = {v: vector[v] + sum(w * vector[u] for u, w in near[v].items()) for v in nodes}
        norm = sum(x * x for x in new.values()) ** 0.5 or 1.0
        vector = {v: x / norm for v, x in new.items()}
    for v in nodes:
        out[v]["betweenness"] = out[v]["betweenness"] / scale if scale > 0 else 0.0
        out[v]["eigenvector"] = vector[v]
        own = sorted(near[v])
        k = len(own)
        triangles = sum((near[v][a] * near[v][b] * near[a][b]) ** (1 / 3) / heaviest for i, a in enumerate(own) for b in own[i + 1 :] if b in near[a])
        out[v]["clustering"] = 2 * triangles / (k * (k - 1)) if k > 1 else 0.0
    return {"nodes": out, "density": 2 * len(edge_rows) / (n * (n - 1)) if n > 1 else 0.0, "components": len({x["component"] for x in out.values()})}


def communities(edge_rows: list[tuple]) -> dict:
    """Communities of a small graph by modularity: nodes move to the neighbouring community of most
    gain, in order, until none moves; then communities become nodes, and so on.  (node: number)."""
    near: dict = {}
    for a, b, w in edge_rows:
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0.0) + w
        near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0.0) + w
    total = sum(sum(x.values()) for x in near.values())
    member = {v: v for v in near}
    graph = near
    while total:
        place = {v: v for v in graph}
        weight = {v: sum(graph[v].values()) for v in graph}
        held = dict(weight)
        moved_at_all = False
        while True:
            moved = False
            for v in sorted(graph, key=str):
                links: dict = {}
                for u, w in graph[v].items():
                    if u != v:
                        links[place[u]] = links.get(place[u], 0.0) + w
                home = place[v]
                held[home] -= weight[v]
                gain = lambda c: links.get(c, 0.0) - held[c] * weight[v] / total  # noqa: B023, E731
                best = max(sorted(links, key=str), key=gain, default=home)
                if gain(best) <= gain(home) + 1e-12:
                    best = home
                held[best] += weight[v]
                if best != home:
                    place[v], moved, moved_at_all = best, True, True
            if not moved:
                break
        if not moved_at_all:
            break
        member = {v: place[c] for v, c in member.items()}
        joined: dict = {}
        for v, x in graph.items():
            for u, w in x.items():
                row = joined.setdefault(place[v], {})
                row[place[u]] = row.get(place[u], 0.0) + w
        graph = joined
    number = {c: n for n, c in enumerate(sorted(set(member.values()), key=str))}
    return {v: number[c] for v, c in member.items()}


def modularity(edge_rows: list[tuple], found: dict) -> float:
    total = sum(w for _, _, w in edge_rows)
    inside: dict = {}
    ends: dict = {}
    for a, b, w in edge_rows:
        ends[found[a]] = ends.get(found[a], 0.0) + w
        ends[found[b]] = ends.get(found[b], 0.0) + w
        if found[a] == found[b]:
            inside[found[a]] = inside.get(found[a], 0.0) + w
    return sum(inside.get(c, 0.0) / total - (ends[c] / (2 * total)) ** 2 for c in ends) if total else 0.0


def write_graph(edge_rows: list[tuple], nodes: dict[str, dict], path: str, kind: str = "graphml", directed: bool = False) -> None:
    """A small graph as GraphML or GEXF, with the nodes' figures as attributes."""
    import xml.etree.ElementTree as ET

    names = sorted({k for x in nodes.values() for k in x})
    way = "directed" if directed else "undirected"
    if kind == "graphml":
        root = ET.Element("graphml", xmlns="http://graphml.graphdrawing.org/xmlns")
        for n in names:
            ET.SubElement(root, "key", id=n, **{"for": "node", "attr.name": n, "attr.type": "string"})
        ET.SubElement(root, "key", id="weight", **{"for": "edge", "attr.name": "weight", "attr.type": "double"})
        graph = ET.SubElement(root, "graph", edgedefault=way)
        for v, x in nodes.items():
            node = ET.SubElement(graph, "node", id=str(v))
            for n in names:
                if x.get(n) is not None:
                    ET.SubElement(node, "data", key=n).text = str(x[n])
        for a, b, w in edge_rows:
            ET.SubElement(ET.SubElement(graph, "edge", source=str(a), target=str(b)), "data", key="weight").text = str(w)
    elif kind == "gexf":
        root = ET.Element("gexf", xmlns="http://gexf.net/1.3", version="1.3")
        graph = ET.SubElement(root, "graph", defaultedgetype=way)
        attributes = ET.SubElement(graph, "attributes", **{"class": "node"})
        for n in names:
            ET.SubElement(attributes, "attribute", id=n, title=n, type="string")
        place = ET.SubElement(graph, "nodes")
        for v, x in nodes.items():
            values = ET.SubElement(ET.SubElement(place, "node", id=str(v), label=str(x.get("name", v))), "attvalues")
            for n in names:
                if x.get(n) is not None:
                    ET.SubElement(values, "attvalue", **{"for": n, "value": str(x[n])})
        place = ET.SubElement(graph, "edges")
        for k, (a, b, w) in enumerate(edge_rows):
            ET.SubElement(place, "edge", id=str(k), source=str(a), target=str(b), weight=str(w))
    else:
        raise ValueError("kind is graphml or gexf")
    ET.ElementTree(root).write(path, encoding="utf-8", xml_declaration=True)
