"""bridges() against all paths of two steps."""

import itertools
import random

from provloom.operators import fmg


def test_every_bridge_is_returned(spark):
    rng = random.Random(2)
    kinds = ("provenance_reachability", "entity_lineage", "entity_continuation")
    names = [f"c{i}" for i in range(12)]
    life = {c: (i * 10, i * 10 + rng.choice((5, 40))) for i, c in enumerate(names)}
    triples = [(a, b, k) for a, b, k in itertools.product(names, names, kinds) if a != b and rng.random() < 0.25 and (a, b) != ("c0", "c11")]
    seen = [(a, b, k, n, f"{a}{b}{n % 3}{k[0]}", None) for a, b, k in triples for n in range(4)]
    witness = spark.createDataFrame(seen, "src_community_id string, dst_community_id string, edge_type string, timestamp_ns long, evidence_id string, entity_uuid string")
    relation = fmg.relations(witness)
    edge = {r.fmg_edge_id: (r.src_community_id, r.dst_community_id, r.edge_type) for r in relation.collect()}
    ids = {k: {e for a, b, t, _, e, _ in seen if (a, b, t) == v} for k, v in edge.items()}
    direct = {v[:2] for v in edge.values()}
    excluded = {("c0", "c11", "c3"), ("c0", "c11", "c5")}

    def want(narrow):
        out = {}
        for x, y in itertools.product(edge, edge):
            (a, m, k), (n, b, t) = edge[x], edge[y]
            if m != n or a == b or (a, b) in direct:
                continue
            first, last = min(life[a][0], life[b][0]), max(life[a][1], life[b][1])
            if narrow and ((a, b, m) in excluded or life[m][1] <= first or life[m][0] >= last):
                continue
            out.setdefault((a, b), []).append((sum(z == "entity_continuation" for z in (k, t)), m, x, y))
        return {(a, b, m, x, y, n + 1) for (a, b), v in out.items() for n, (_, m, x, y) in enumerate(sorted(v))}

    row = lambda r: (r.left_id, r.right_id, r.middle_id, r.first_edge, r.second_edge, r.rank)
    got = {row(r) for r in fmg.bridges(relation).collect()}
    assert got == want(False) and max(r[-1] for r in got) > 3
    communities = spark.createDataFrame([(c, *t) for c, t in life.items()], "community_id string, start_ns long, end_ns long")
    out = fmg.bridges(relation, communities, spark.createDataFrame(list(excluded), "left_id string, right_id string, middle_id string"), witness).collect()
    assert {row(r) for r in out} == want(True) and len(out) < len(got)
    assert all(r.witness_ids == sorted(ids[r.first_edge] | ids[r.second_edge]) for r in out)
