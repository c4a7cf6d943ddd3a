"""Product-keyword graphs as node and edge tables.

Edges, weights, degrees, components and summaries are DataFrame plans. Betweenness, communities and layout are iterative
algorithms over one graph: they run as a grouped-map kernel over graphs whose size the caps on products and keywords bound.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.columns import action_class, finite, first_filled, log_weight, short_label
from bidweave.operators.reports import with_total
from bidweave.operators.text import paired_similarity, phrase, tfidf, top_keywords, cosine_pairs, keyword_similarity
from bidweave.session import written

SUMS = ["clicks", "cost", "sales_attr", "orders_attr"]


def keyword_rows(decided: DataFrame, *, compatible: bool = True) -> DataFrame:
    """Keyword decisions with a product and a phrase. Only keywords that NFKC may change go through Python."""
    rows = decided.where(F.upper("entity_type") == "KEYWORD")
    # ASCII alone: as many bytes as characters.
    plain = F.coalesce(F.octet_length("keyword") == F.length("keyword"), F.lit(True))
    if compatible:
        out = rows.where(plain).withColumn("keyword_normalized", phrase(F.col("keyword"), compatible=False)).unionByName(rows.where(~plain).withColumn("keyword_normalized", phrase(F.col("keyword"))))
    else:
        out = rows.withColumn("keyword_normalized", phrase(F.col("keyword"), compatible=False))
    return out.withColumn("product_id", _product()).where("product_id <> '' AND keyword_normalized <> ''")


def _product() -> Column:
    return F.trim(F.coalesce("product_id", F.lit("")))


def _ranked(edges: DataFrame, key: str, most: int) -> DataFrame:
    return edges.groupBy(key).agg(F.sum("edge_value").alias("__v")).orderBy(F.desc("__v"), key).limit(most).select(key)


def bipartite_edges(decided: DataFrame, *, metric: str = "sales_attr", max_products: int = 50, max_keywords: int = 110, min_value: float = 0.0, selected: list[str] | None = None, compatible: bool = True, relevance: bool = True) -> DataFrame:
    """One edge a product and keyword, of the products and of the keywords with the greatest values, each ranked by itself.

    The sums that edges are ranked by are made of all rows and written once. What else edges hold is made of the rows of the products
    that are left, so that of other rows no more of the decisions is made than those sums ask for.
    """
    rows = keyword_rows(decided, compatible=compatible)
    if selected:
        rows = rows.where(F.col("product_id").isin(selected))
    value = F.avg(metric) if metric == "roas_attr_pct" else F.coalesce(F.sum(metric), F.lit(0.0))
    # Without any value, clicks stand in. The total is one row.
    pairs = ["product_id", "keyword_normalized"]
    sums = written(rows.groupBy(*pairs).agg(value.alias("edge_value"), F.coalesce(F.sum("clicks"), F.lit(0.0)).alias("clicks")), "edge_sums")
    edges = with_total(sums, F.col("edge_value"))
    edges = edges.withColumn("edge_value", F.when(F.col("__total") > 0, F.col("edge_value")).otherwise(F.greatest("clicks", F.lit(1.0)))).drop("__total").where(F.col("edge_value") >= min_value)
    # max_products names at most, as a list: that reaches the rows before they are decided, which a join doesn't.
    top = [r[0] for r in _ranked(edges, "product_id", max_products).collect()]
    edges = written(edges.where(F.col("product_id").isin(top)).join(_ranked(edges, "keyword_normalized", max_keywords), "keyword_normalized", "left_semi").drop("clicks"), "top_pairs")
    few = keyword_rows(decided.where(_product().isin(top)), compatible=compatible)
    first = {c: F.min_by(c, F.struct(F.col(c).isNull(), F.col("keyword"))).alias(c) for c in ("product_name", "category", "product_group", "decision_status", "action") if c in rows.columns}
    figures = few.groupBy(*pairs).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS], F.avg("roas_attr_pct").alias("roas_attr_pct"), F.min("keyword").alias("keyword_display"), *first.values())
    edges = edges.join(figures, pairs)
    # From here on the caps bound the table.
    edges = written(edges, "top_edges")
    edges = edges.crossJoin(edges.agg(F.max("edge_value").alias("__largest"))).withColumns({
        "product_name_resolved": first_filled(F.col("product_name") if "product_name" in first else F.lit(""), F.col("product_id")), "layout_weight": log_weight(F.col("edge_value"), F.col("__largest")),
        "source": F.concat(F.lit("P|"), "product_id"), "target": F.concat(F.lit("K|"), "keyword_normalized"),
    }).drop("__largest")
    if not relevance:
        return edges
    texts = edges.select(F.struct(*pairs).alias("id"), phrase(F.col("product_name_resolved"), compatible=compatible).alias("left"), F.col("keyword_normalized").alias("right"))
    scores = paired_similarity(texts).select(F.col("id.product_id").alias("product_id"), F.col("id.keyword_normalized").alias("keyword_normalized"), F.col("similarity").alias("semantic_relevance"))
    return edges.join(scores, pairs)


def product_nodes(edges: DataFrame, decided: DataFrame, metric: str = "sales_attr") -> DataFrame:
    """One node a product of the edges, with its own row's figures where it has one, else its edges'."""
    from_edges = edges.groupBy("product_id").agg(F.sum("edge_value").alias("value"), *[F.sum(c).alias(c) for c in SUMS], F.avg("roas_attr_pct").alias("roas_attr_pct"), F.min("product_name_resolved").alias("name"))
    own = ["clicks", "cost", "sales_attr", "orders_attr", "roas_attr_pct", "current_bid", "recommended_cpc", "action", "decision_status", "expected_incremental_profit", "category", "product_group"]
    own = [c for c in own if c in decided.columns]
    items = decided.where(F.upper("entity_type") == "ITEM").join(edges.select("product_id").distinct(), "product_id", "left_semi")
    items = items.groupBy("product_id").agg(F.max_by(F.struct(F.col(metric).alias("__metric"), *own), F.struct(F.coalesce(metric, F.lit(0.0)))).alias("item"))
    out = from_edges.join(items, "product_id", "left")

    def pick(c: str) -> Column:
        mine = F.col(f"item.{c}")
        return F.coalesce(mine, F.col(c)) if c in from_edges.columns else mine

    return out.select(
        F.concat(F.lit("P|"), "product_id").alias("node_id"), F.lit("PRODUCT").alias("node_type"), short_label(F.col("name"), 24).alias("label"), F.col("name").alias("full_label"), "product_id", F.lit("").alias("keyword"),
        F.coalesce("item.__metric", "value").cast("double").alias("value"), *[pick(c).alias(c) for c in own],
    )


def keyword_nodes(edges: DataFrame) -> DataFrame:
    """One node a keyword of the edges, with the action of its greatest edge and the number of its products."""
    dominant = [c for c in ("action", "decision_status") if c in edges.columns]
    out = edges.groupBy("keyword_normalized").agg(
        F.sum("edge_value").alias("value"), *[F.sum(c).alias(c) for c in SUMS], F.avg("roas_attr_pct").alias("roas_attr_pct"), F.min("keyword_display").alias("keyword"), F.countDistinct("product_id").alias("product_count"),
        *[F.max_by(c, F.struct("edge_value", "product_id")).alias(c) for c in dominant],
    )
    return out.select(F.concat(F.lit("K|"), "keyword_normalized").alias("node_id"), F.lit("KEYWORD").alias("node_type"), short_label(F.col("keyword"), 18).alias("label"), F.col("keyword").alias("full_label"), F.lit("").alias("product_id"), "keyword", "value", *SUMS, "roas_attr_pct", "product_count", *dominant)


def keyword_similarity_graph(decided: DataFrame, *, most: int = 120, threshold: float = 0.34, compatible: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (also those without edges) and edges between similar keywords."""
    rows = keyword_rows(decided, compatible=compatible)
    nodes = top_keywords(rows, "sales_attr", most).select(F.concat(F.lit("K|"), "keyword_normalized").alias("node_id"), F.lit("KEYWORD").alias("node_type"), F.col("keyword_normalized").alias("keyword"), "value")
    edges = keyword_similarity(rows, most=most, threshold=threshold, k=4).select(F.concat(F.lit("K|"), "source").alias("source"), F.concat(F.lit("K|"), "target").alias("target"), "similarity", (0.25 + F.col("similarity") * 3.5).alias("layout_weight"))
    return nodes, edges


def product_similarity_edges(decided: DataFrame, *, metric: str = "sales_attr", max_products: int = 80, threshold: float = 0.18, compatible: bool = True) -> DataFrame:
    """Edges between products: 0.7 of their keywords' Jaccard index and 0.3 of their names' similarity, at the threshold or above."""
    rows = keyword_rows(decided, compatible=compatible)
    top = rows.groupBy("product_id").agg(F.sum(metric).alias("v")).orderBy(F.desc_nulls_last("v"), "product_id").limit(max_products).select("product_id")
    sets = written(rows.join(top, "product_id", "left_semi").select("product_id", "keyword_normalized").distinct(), "keyword_sets")
    sizes = sets.groupBy("product_id").agg(F.count("*").alias("n"))
    shared = sets.withColumnRenamed("product_id", "left").join(sets.withColumnRenamed("product_id", "right"), "keyword_normalized").where("left < right").groupBy("left", "right").agg(F.count("*").alias("shared"))
    jaccard = shared.join(sizes.withColumnsRenamed({"product_id": "left", "n": "nl"}), "left").join(sizes.withColumnsRenamed({"product_id": "right", "n": "nr"}), "right").select("left", "right", (F.col("shared") / (F.col("nl") + F.col("nr") - F.col("shared"))).alias("jaccard"))
    items = decided.where(F.upper("entity_type") == "ITEM").groupBy("product_id").agg(F.max_by("product_name", F.struct(F.coalesce(metric, F.lit(0.0)), F.col("product_name"))).alias("name"))
    names = sets.select("product_id").distinct().join(items, "product_id", "left").select(F.col("product_id").alias("id"), phrase(F.coalesce("name", "product_id"), compatible=compatible).alias("text"))
    both = jaccard.join(cosine_pairs(tfidf(names)), ["left", "right"], "full_outer").select("left", "right", F.coalesce("jaccard", F.lit(0.0)).alias("shared_keyword_jaccard"), F.coalesce("similarity", F.lit(0.0)).alias("name_similarity"))
    both = both.withColumn("similarity", 0.7 * F.col("shared_keyword_jaccard") + 0.3 * F.col("name_similarity")).where(F.col("similarity") >= threshold)
    return both.select(F.concat(F.lit("P|"), "left").alias("source"), F.concat(F.lit("P|"), "right").alias("target"), "similarity", "shared_keyword_jaccard", "name_similarity", (0.25 + F.col("similarity") * 4).alias("layout_weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node_id"), F.col("target").alias("other"), "layout_weight").unionByName(edges.select(F.col("target").alias("node_id"), F.col("source").alias("other"), "layout_weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node_id").agg(F.sum("layout_weight").alias("weighted_degree"), F.count("*").alias("degree"))


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node_id, component): the smallest node_id that edges lead to. Labels spread to neighbours, and to whom these point."""
    links = written(both_ways(edges).select("node_id", "other").distinct(), "links")
    labels = written(nodes.select("node_id", F.col("node_id").alias("component")), "labels")
    for _ in range(most_rounds):
        near = links.join(labels.withColumnsRenamed({"node_id": "other", "component": "seen"}), "other").groupBy("node_id").agg(F.min("seen").alias("seen"))
        new = labels.join(near, "node_id", "left").select("node_id", F.least("component", "seen").alias("component"), (F.col("seen") < F.col("component")).alias("moved"))
        leap = new.select(F.col("node_id").alias("component"), F.col("component").alias("further"))
        new = written(new.join(leap, "component", "left").select("node_id", F.coalesce("further", "component").alias("component"), (F.coalesce("moved", F.lit(False)) | F.coalesce(F.col("further") < F.col("component"), F.lit(False))).alias("moved")), "labels")
        labels = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"labels still move after {most_rounds} rounds")


def _brandes(adjacent: list[list[tuple[int, float]]], sources: list[int]) -> np.ndarray:
    """Shortest-path counts through each node from the sources (Brandes 2001), with distances as weights."""
    score = np.zeros(len(adjacent))
    for s in sources:
        distance, paths, before, order = {s: 0.0}, {s: 1.0}, {s: []}, []
        heap, done = [(0.0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for w, length in adjacent[v]:
                new = d + length
                old = distance.get(w)
                if old is None or new < old - 1e-12:
                    distance[w], paths[w], before[w] = new, paths[v], [v]
                    heapq.heappush(heap, (new, w))
                elif abs(new - old) <= 1e-12 and w not in done:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    return score


def _communities(n: int, edges: list[tuple[int, int, float]]) -> list[int]:
    """Greedy modularity (Clauset, Newman and Moore 2004): the two communities whose union gains most are merged until none gains."""
    total = sum(w for *_, w in edges)
    between: list[dict[int, float]] = [{} for _ in range(n)]
    degree = [0.0] * n
    for a, b, w in edges:
        between[a][b] = between[a].get(b, 0.0) + w / total / 2
        between[b][a] = between[b].get(a, 0.0) + w / total / 2
        degree[a] += w / total / 2
        degree[b] += w / total / 2
    members = {i: [i] for i in range(n)}
    while True:
        gain, a, b = max(((2 * (w - degree[a] * degree[b]), -a, -b) for a in members for b, w in between[a].items() if a < b), default=(0.0, 0, 0))
        if gain <= 1e-15:
            break
        a, b = -a, -b
        for c, w in between[b].items():
            if c != a:
                between[a][c] = between[a].get(c, 0.0) + w
                between[c][a] = between[a][c]
            between[c].pop(b, None)
        between[b] = {}
        degree[a] += degree[b]
        members[a] += members.pop(b)
    out = [0] * n
    for k, group in enumerate(sorted(members.values(), key=lambda g: (-len(g), min(g)))):
        for i in group:
            out[i] = k
    return out


def _layout(n: int, edges: list[tuple[int, int, float]], rounds: int, seed: int) -> np.ndarray:
    """Fruchterman and Reingold's forces, within the unit square around the centre."""
    position = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    k, weights = 1.55 / math.sqrt(max(n, 2)), np.zeros((n, n))
    for a, b, w in edges:
        weights[a, b] = weights[b, a] = w
    for step in np.linspace(0.2, 0.002, rounds):
        apart = position[:, None] - position[None]
        length = np.maximum(np.linalg.norm(apart, axis=2), 0.01)
        move = (apart * (k * k / length**2 - weights * length / k)[:, :, None]).sum(axis=1)
        position += move / np.maximum(np.linalg.norm(move, axis=1, keepdims=True), 0.01) * step
    position -= position.mean(axis=0)
    return position / max(np.abs(position).max(), 1e-9)


def graph_metrics(nodes: DataFrame, edges: DataFrame, *, exact: int = 180, pivots: int = 80, seed: int = 17, layout: bool = True) -> DataFrame:
    """(node_id, bridge_score, community, x, y) of one bounded graph; x and y are left out without layout.

    bridge_score is the normalised betweenness with distances 1 / layout_weight; above `exact` nodes it is estimated from
    `pivots` of them, evenly through the sorted names. Nodes without edges are communities of their own.
    """
    one = F.lit(0)
    rows = nodes.select(one.alias("graph"), "node_id", F.lit(None).cast("string").alias("other"), F.lit(0.0).alias("w")).unionByName(edges.select(one.alias("graph"), F.col("source").alias("node_id"), F.col("target").alias("other"), F.col("layout_weight").alias("w")))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["node_id"]) | set(pdf["other"].dropna()))
        place = {x: i for i, x in enumerate(names)}
        links = sorted((min(place[a], place[b]), max(place[a], place[b]), float(w)) for a, b, w in pdf.dropna(subset=["other"])[["node_id", "other", "w"]].itertuples(index=False))
        n = len(names)
        adjacent: list[list[tuple[int, float]]] = [[] for _ in names]
        for a, b, w in links:
            adjacent[a].append((b, 1 / max(w, 1e-9)))
            adjacent[b].append((a, 1 / max(w, 1e-9)))
        sources = list(range(n)) if n <= exact else sorted({int(i * n / pivots) for i in range(pivots)})
        scale = n / len(sources) / ((n - 1) * (n - 2)) if n > 2 else 0.0
        out = pd.DataFrame({"node_id": names, "bridge_score": _brandes(adjacent, sources) * scale if n else [], "community": _communities(n, links) if links else list(range(n))})
        if not layout:
            return out
        xy = _layout(n, links, 160 if n <= exact else 95, seed) if n > 1 else np.zeros((n, 2))
        return out.assign(x=xy[:, 0], y=xy[:, 1])

    return rows.groupBy("graph").applyInPandas(kernel, "node_id string, bridge_score double, community int" + (", x double, y double" if layout else ""))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of nodes (with value and community) and edges: counts, density, the share of the first ten products and of the largest community."""
    product = F.col("node_type") == "PRODUCT"
    totals = nodes.agg(
        F.count_if(product).alias("products"), F.count_if(F.col("node_type") == "KEYWORD").alias("keywords"), F.countDistinct("community").alias("clusters"), F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(product, F.col("value"))), F.lit(0.0)).alias("product_total"),
    )
    first = nodes.where(product).orderBy(F.desc("value"), "node_id").limit(10).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("top10"))
    largest = nodes.groupBy("community").agg(F.sum("value").alias("v")).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("largest"))
    # All four are aggregates of one row.
    out = totals.crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(largest).crossJoin(first)
    return out.select(
        "products", "keywords", "edges", "clusters", F.when(F.col("n") > 1, 2 * F.col("edges") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"),
        F.when(F.col("product_total") > 0, F.col("top10") / F.col("product_total") * 100).otherwise(0.0).alias("top10_share_pct"), F.when(F.col("total") > 0, F.col("largest") / F.col("total") * 100).otherwise(0.0).alias("largest_cluster_share_pct"),
    )


def leading(edges: DataFrame, key: str = "source") -> Column:
    """The node whose edges have the greatest value, as a scalar of one row."""
    return edges.groupBy(key).agg(F.sum("edge_value").alias("v")).agg(F.min_by(key, F.struct(-F.col("v"), F.col(key)))).scalar()


def top_bridges(nodes: DataFrame, n: int = 9) -> DataFrame:
    """The nodes that join parts of the graph: by bridge_score, then by weighted degree."""
    return nodes.orderBy(F.desc("bridge_score"), F.desc("weighted_degree"), "node_id").limit(n)


def top_entities(nodes: DataFrame, node_type: str, n: int = 10) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type).orderBy(F.desc("weighted_degree"), F.desc("value"), "node_id").limit(n)


def neighbourhood(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """Nodes whose label has the text, blind to case, and the nodes next to them, with `hit` for the former."""
    hits = nodes.where(F.contains(F.lower("full_label"), F.lit(text.lower()))).select("node_id")
    near = both_ways(edges).join(hits.withColumnRenamed("node_id", "other"), "other", "left_semi").select("node_id")
    marked = hits.withColumn("hit", F.lit(True)).unionByName(near.withColumn("hit", F.lit(False))).groupBy("node_id").agg(F.max("hit").alias("hit"))
    return nodes.join(marked, "node_id")


def ego(edges: DataFrame, node_id: str | Column, most: int = 12, value: str = "edge_value") -> DataFrame:
    """The node's edges to its `most` neighbours of the greatest value."""
    centre = F.lit(node_id) if isinstance(node_id, str) else node_id
    mine = edges.withColumn("__centre", centre).where((F.col("source") == F.col("__centre")) | (F.col("target") == F.col("__centre")))
    mine = mine.withColumn("other", F.when(F.col("source") == F.col("__centre"), F.col("target")).otherwise(F.col("source"))).drop("__centre")
    return mine.orderBy(F.desc(value), "other").limit(most)


def payload(nodes: DataFrame, edges: DataFrame, totals: DataFrame, *, metric: str = "sales_attr", graph_kind: str = "relationship", target_roas_pct: float = 450.0) -> DataFrame:
    """One row: the graph as JSON text for a browser, numbers finite and `</` escaped. For graphs that the caps bound.

    Nodes and edges have the fields that a browser draws and filters by; what a table has no column of is 0 or empty. A
    product's label is its id, a keyword's its keyword, any other's its full label. Edges of which an end is no node are left out.
    """

    def number(df: DataFrame, *names: str, default: float = 0.0) -> Column:
        return next((finite(F.col(n), default) for n in names if n in df.columns), F.lit(default))

    def word(df: DataFrame, *names: str) -> Column:
        return next((F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns), F.lit(""))

    def whole(df: DataFrame, name: str) -> Column:
        return number(df, name).cast("long")

    kind = F.upper(F.coalesce("node_type", F.lit("KEYWORD"))) if "node_type" in nodes.columns else F.lit("KEYWORD")
    product, keyword, full = word(nodes, "product_id"), word(nodes, "keyword"), word(nodes, "full_label", "label")
    points = nodes.select(F.struct(
        F.col("node_id").alias("id"), kind.alias("type"), F.when((kind == "PRODUCT") & (product != ""), product).when(keyword != "", keyword).otherwise(full).alias("label"), full.alias("fullLabel"), product.alias("productId"), keyword.alias("keyword"),
        word(nodes, "category").alias("category"), word(nodes, "product_group").alias("group"), number(nodes, "value").alias("value"), number(nodes, "sales_attr", "value").alias("sales"), number(nodes, "clicks").alias("clicks"),
        number(nodes, "cost").alias("cost"), number(nodes, "orders_attr").alias("orders"), number(nodes, "roas_attr_pct").alias("roas"), number(nodes, "expected_incremental_profit").alias("profit"), number(nodes, "weighted_degree").alias("degree"),
        number(nodes, "bridge_score").alias("bridge"), whole(nodes, "community").alias("community"), whole(nodes, "product_count").alias("productCount"), action_class(word(nodes, "action"), word(nodes, "decision_status")).alias("action"),
        word(nodes, "action").alias("actionRaw"), word(nodes, "decision_status").alias("status"), number(nodes, "current_bid").alias("currentBid"), number(nodes, "recommended_cpc").alias("recommendedCpc"), number(nodes, "x").alias("x"), number(nodes, "y").alias("y"),
    ).alias("node"))
    whole_edges = edges.join(nodes.select(F.col("node_id").alias("source")), "source", "left_semi").join(nodes.select(F.col("node_id").alias("target")), "target", "left_semi")
    lines = whole_edges.select(F.struct(
        "source", "target", number(edges, "edge_value", "similarity", default=1.0).alias("value"), number(edges, "sales_attr", "edge_value").alias("sales"), number(edges, "clicks").alias("clicks"), number(edges, "cost").alias("cost"),
        number(edges, "orders_attr").alias("orders"), number(edges, "roas_attr_pct").alias("roas"), number(edges, "semantic_relevance", "similarity").alias("relevance"), action_class(word(edges, "action"), word(edges, "decision_status")).alias("action"),
    ).alias("edge"))
    sums = F.struct(*[(finite(F.col(c), 0.0) if t == "double" else F.col(c)).alias(c) for c, t in totals.dtypes])
    # Each is one row.
    parts = points.agg(F.sort_array(F.collect_list("node")).alias("nodes")).crossJoin(lines.agg(F.sort_array(F.collect_list("edge")).alias("edges"))).crossJoin(totals.select(sums.alias("summary")))
    rest = [F.lit(metric).alias("metric"), F.lit(graph_kind).alias("graphKind"), F.lit(target_roas_pct).alias("targetRoasPct")]
    return parts.select(F.replace(F.to_json(F.struct("nodes", "edges", "summary", *rest)), F.lit("</"), F.lit("<\\/")).alias("payload"))
