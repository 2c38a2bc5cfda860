"""Bounded retrieval of edges around seeds, inside one interval's graph (whose size the bisection bounds)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, islice, zip_longest

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE = "src_uuid string, dst_uuid string, event_type string, predicate_index int, first_timestamp_ns long, first_event_uuid string"
COLUMNS = ["src_uuid", "dst_uuid", "event_type", "predicate_index", "first_timestamp_ns", "first_event_uuid"]


class Around:
    """Edges of one interval by their ends: out of a node (way 0) and into it (way 1), in order of time, ends and type."""

    def __init__(self, edges: pd.DataFrame) -> None:
        order = edges.sort_values(["first_timestamp_ns", "src_uuid", "dst_uuid", "event_type", "predicate_index"], kind="stable")
        self.edges = list(order[COLUMNS].itertuples(index=False, name="Edge"))
        self.at: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
        for i, e in enumerate(self.edges):
            self.at[0].setdefault(e.src_uuid, []).append(i)
            self.at[1].setdefault(e.dst_uuid, []).append(i)

    def far(self, way: int, i: int) -> str:
        return self.edges[i].src_uuid if way else self.edges[i].dst_uuid

    def breadth_first(self, seed: str, hops: int) -> Iterator[tuple[int, int, int]]:
        """(edge, way, hop): both ways start at the seed and take turns node by node; an edge comes once a way."""
        seen = ({seed}, {seed})
        todo = deque([(0, seed, 1), (1, seed, 1)])
        while todo:
            way, node, hop = todo.popleft()
            for i in self.at[way].get(node, ()):
                yield i, way, hop
                nxt = self.far(way, i)
                if hop < hops and nxt not in seen[way]:
                    seen[way].add(nxt)
                    todo.append((way, nxt, hop + 1))

    def covering(self, seed: str, hops: int, types: set[str], scores: dict[str, float], budget: int) -> Iterator[tuple[int, int, int]]:
        """One edge for each neighbour first (those with an edge of the given types before the others), then the
        neighbours' other edges, the two ways in turn; then what the first `budget` edges of a breadth-first search add."""
        tiers: list[list[list[int]]] = [[[], []], [[], []], [[], []]]
        for way in (0, 1):
            by: dict[str, list[int]] = {}
            for i in self.at[way].get(seed, ()):
                by.setdefault(self.far(way, i), []).append(i)
            for mine in by.values():
                liked = [i for i in mine if self.edges[i].event_type in types]
                best = (liked or mine)[0]
                tiers[0 if liked else 1][way].append(best)
                tiers[2][way] += [i for i in mine if i != best]
            for tier in tiers:
                tier[way].sort(key=lambda i: (-scores.get(self.far(way, i), float("-inf")), i))  # noqa: B023
        used: set[int] = set()
        for pair in chain.from_iterable(zip_longest(*tier) for tier in tiers):
            for way, i in enumerate(pair):
                if i is not None and i not in used:
                    used.add(i)
                    yield i, way, 1
        if hops > 1:
            mark = lambda i: (self.edges[i].src_uuid, self.edges[i].dst_uuid, self.edges[i].event_type, self.edges[i].first_timestamp_ns)
            had = {mark(i) for i in used}
            for i, way, hop in islice(self.breadth_first(seed, hops), budget):
                if mark(i) not in had:
                    had.add(mark(i))
                    yield i, way, hop

    def context(self, seed: str, types: set[str], scores: dict[str, float], budget: int) -> list[int]:
        """Edges of the seed, then of its neighbours in order of id, incoming and outgoing in turn, the most telling first."""

        def ranked(node: str) -> Iterator[int]:
            def key(i: int):
                e = self.edges[i]
                other = e.dst_uuid if e.src_uuid == node else e.src_uuid
                return (e.event_type not in types, -scores.get(other, 0.0), e.first_timestamp_ns, e.first_event_uuid, e.predicate_index, e.src_uuid, e.dst_uuid)

            sides = [sorted(self.at[way].get(node, ()), key=key) for way in (1, 0)]
            return (i for pair in zip_longest(*sides) for i in pair if i is not None)

        chosen = dict.fromkeys(take(ranked(seed), budget))
        near = sorted({n for i in chosen for n in (self.edges[i].src_uuid, self.edges[i].dst_uuid)} - {seed})
        for node in near:
            for i in ranked(node):
                if len(chosen) >= budget:
                    return list(chosen)
                chosen.setdefault(i)
        return list(chosen)


def take(items: Iterator[int], n: int) -> list[int]:
    """The first n distinct items."""
    out: dict[int, None] = {}
    for i in items:
        out.setdefault(i)
        if len(out) >= n:
            break
    return list(out)


def _per_interval(edges: DataFrame, seeds: DataFrame, scores: DataFrame | None, each: Callable[[Around, object, dict], list[tuple]], schema: str, scope: str) -> DataFrame:
    """each(graph, seed row, scores) -> rows, for every seed of every interval. Only intervals with seeds are read."""
    names = [c.split()[0] for c in schema.split(", ")]
    edges = edges.join(seeds.select(scope).distinct(), scope, "left_semi").select(F.col(scope).alias("scope"), *COLUMNS)
    extra = seeds.select(F.col(scope).alias("scope"), F.col("node_uuid").alias("node"), F.lit(True).alias("is_seed"), *([F.col("event_types")] if "event_types" in seeds.columns else [F.array().cast("array<string>").alias("event_types")]), F.lit(None).cast("double").alias("q"))
    if scores is not None:
        extra = extra.unionByName(scores.join(seeds.select(scope).distinct(), scope, "left_semi").select(F.col(scope).alias("scope"), F.col("node_uuid").alias("node"), F.lit(False).alias("is_seed"), F.array().cast("array<string>").alias("event_types"), F.col("q").cast("double").alias("q")))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        graph, known = Around(left), right[~right["is_seed"]]
        q = {n: v for n, v in zip(known["node"], known["q"], strict=True) if v == v}
        mine = right[right["is_seed"]].sort_values("node")
        rows = [(key[0], s.node, *r) for s in mine.itertuples(index=False) for r in each(graph, s, q)]
        return pd.DataFrame(rows, columns=names)

    return edges.groupBy("scope").cogroup(extra.groupBy("scope")).applyInPandas(run, schema).withColumnRenamed("scope", scope)


_OUT = "scope string, seed_uuid string, position int, " + EDGE


def bounded_search(edges: DataFrame, seeds: DataFrame, hops: int = 2, budget: int = 40, scope: str = "pg_id") -> DataFrame:
    """Breadth-first edges both ways from each seed (scope, node_uuid), until the budget: traversal_direction, hop, position."""
    if hops < 1 or budget < 1:
        raise ValueError("hops and budget must be positive")

    def each(g: Around, s, q):
        found = zip(range(1, budget + 1), g.breadth_first(s.node, hops), strict=False)
        return [(n, *g.edges[i], ("forward", "backward")[way], hop) for n, (i, way, hop) in found]

    return _per_interval(edges, seeds, None, each, _OUT + ", traversal_direction string, hop int", scope)


def neighbor_cover(edges: DataFrame, seeds: DataFrame, scores: DataFrame | None = None, hops: int = 2, budget: int = 40, scope: str = "pg_id") -> DataFrame:
    """As bounded_search, but distinct neighbours come first. seeds may have event_types that go before others."""
    if hops < 1 or budget < 1:
        raise ValueError("hops and budget must be positive")

    def each(g: Around, s, q):
        found = zip(range(1, budget + 1), g.covering(s.node, hops, set(s.event_types), q, budget), strict=False)
        return [(n, *g.edges[i], ("forward", "backward")[way], hop) for n, (i, way, hop) in found]

    return _per_interval(edges, seeds, scores, each, _OUT + ", traversal_direction string, hop int", scope)


def bounded_context(edges: DataFrame, seeds: DataFrame, scores: DataFrame | None = None, budget: int = 40, scope: str = "pg_id") -> DataFrame:
    """References (seed, position, edge) to the edges that a budget a seed allows, the most telling first."""
    return _per_interval(edges, seeds, scores, lambda g, s, q: [(n, *g.edges[i]) for n, i in enumerate(g.context(s.node, set(s.event_types), q, budget), 1)], _OUT, scope)
