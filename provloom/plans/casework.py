"""Registered queries of communities, the memory graph, bridges, assessments, controllers and checks, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents, communities, control, features, fmg, graph, incremental
from ..operators.shared import settled
from ..sources.adapter import DAY_NS, FIRST_DAY_NS, events, node_definitions, table
from .nodes import LEAF_ROWS, LEAVES, TYPE_ID, leaf_features, leaves
from .registry import ALL_SCORES, FMG, HOUR, PERCENTILE, WITH, _day, _fmg, _percentiles, query

RECURSIVE = LEAVES.replace("WITH", "WITH RECURSIVE", 1)
LABELS = f"""{RECURSIVE}, {LEAF_ROWS}, un AS (SELECT DISTINCT pg_id, src_uuid AS a, dst_uuid AS b FROM lc UNION SELECT DISTINCT pg_id, dst_uuid, src_uuid FROM lc
), low AS (SELECT nf.pg_id, nf.node_uuid FROM nf LEFT JOIN (SELECT pg_id, a, min(b) AS m FROM un GROUP BY ALL) x ON x.pg_id = nf.pg_id AND a = node_uuid WHERE m IS NULL OR node_uuid < m
), reach AS (SELECT pg_id, node_uuid, node_uuid AS r FROM low UNION SELECT un.pg_id, un.b, reach.r FROM reach JOIN un ON un.pg_id = reach.pg_id AND un.a = reach.node_uuid
), root AS (SELECT pg_id, node_uuid, min(r) AS r FROM reach GROUP BY ALL), label AS (SELECT pg_id, node_uuid, dense_rank() OVER (PARTITION BY pg_id ORDER BY r) - 1 AS label FROM root
), lm AS (SELECT pg_id, node_uuid, format('d{{:02d}}:{{}}:c{{:05d}}', logical_day, pg_id, label) AS community_id FROM label JOIN nf USING (pg_id, node_uuid))"""
KIND = "CASE WHEN edge_type LIKE '%continuation' THEN 'identity_continuity' ELSE 'causal_event' END"
LEAF_FMG = f"""{LEAVES}, {LEAF_ROWS}, lm AS (SELECT pg_id, node_uuid, format('d{{:02d}}:{{}}:c{{:05d}}', logical_day, pg_id, {TYPE_ID}) AS community_id FROM nf
), wit AS (SELECT pg_id, src_uuid, dst_uuid, event_type, 'event:' || first_event_uuid || ':p' || predicate_index AS evidence_id, f[1] AS ts FROM lc
), dir AS (SELECT s.community_id AS src_community_id, d.community_id AS dst_community_id, CASE WHEN event_type IN ('EVENT_FORK', 'EVENT_EXECUTE') THEN 'entity_lineage' ELSE 'provenance_reachability' END AS edge_type, ts, evidence_id, 'event' AS side, NULL AS entity_uuid FROM wit JOIN lm s ON s.pg_id = wit.pg_id AND s.node_uuid = src_uuid JOIN lm d ON d.pg_id = wit.pg_id AND d.node_uuid = dst_uuid WHERE s.community_id <> d.community_id
), occ AS (SELECT pg_id, node_uuid, min((ts, evidence_id)) AS f, max((ts, evidence_id)) AS l FROM (SELECT pg_id, src_uuid AS node_uuid, ts, evidence_id FROM wit UNION ALL SELECT pg_id, dst_uuid, ts, evidence_id FROM wit) GROUP BY ALL
), nxt AS (SELECT pg_id, end_ns, start_ns // {DAY_NS} AS day, lead(pg_id) OVER w AS right_pg, lead(start_ns) OVER w AS right_start FROM leaf WINDOW w AS (ORDER BY start_ns, end_ns, pg_id)
), pairs AS (SELECT a.community_id AS src_community_id, b.community_id AS dst_community_id, CASE WHEN day = right_start // {DAY_NS} THEN 'split_continuation' ELSE 'entity_continuation' END AS edge_type, a.node_uuid AS entity_uuid, oa.l AS l, ob.f AS f FROM nxt JOIN lm a ON a.pg_id = nxt.pg_id JOIN lm b ON b.pg_id = right_pg AND b.node_uuid = a.node_uuid JOIN occ oa ON oa.pg_id = a.pg_id AND oa.node_uuid = a.node_uuid JOIN occ ob ON ob.pg_id = b.pg_id AND ob.node_uuid = b.node_uuid WHERE end_ns = right_start AND oa.l[1] <= ob.f[1]
), cont AS (SELECT src_community_id, dst_community_id, edge_type, l[1] AS ts, l[2] AS evidence_id, 'left' AS side, entity_uuid FROM pairs UNION ALL SELECT src_community_id, dst_community_id, edge_type, f[1], f[2], 'right', entity_uuid FROM pairs
), lrel AS (SELECT 'fmg-' || substr(sha256(edge_type || chr(0) || src_community_id || chr(0) || dst_community_id), 1, 24) AS fmg_edge_id, src_community_id, dst_community_id, edge_type, count(*) AS witness_count, count(DISTINCT entity_uuid) AS witness_entity_count, min(ts) AS first_witness_ns, max(ts) AS last_witness_ns, {KIND} AS evidence_semantics, CASE WHEN edge_type LIKE '%continuation' THEN 'continues' ELSE 'before' END AS time_relation FROM (SELECT * FROM dir UNION ALL SELECT * FROM cont) GROUP BY src_community_id, dst_community_id, edge_type)"""


@query(f"{LABELS} SELECT pg_id, node_uuid, community_id FROM lm")
def connected_communities(spark, sf):
    nodes, comp = leaf_features(spark, sf)
    nodes = settled(nodes.select("pg_id", "node_uuid", "logical_day"))
    return communities.labelled(nodes, communities.connected(nodes, comp)).select("pg_id", "node_uuid", "community_id")


@query()
def modularity_communities(spark, sf):
    nodes, comp = leaf_features(spark, sf)
    nodes = nodes.select("pg_id", "node_uuid", "logical_day")
    return communities.labelled(nodes, communities.modularity_communities(nodes, comp)).select("pg_id", "node_uuid", "community_id")


def _leaf_fmg(spark: SparkSession, sf: str):
    """Members (communities by type), evidence, intervals and witnesses of intervals that bisection has cut."""
    _, pgs, touch, edges = leaves(spark, sf)
    nodes = features.typed(touch.groupBy("pg_id", "node_uuid").agg(F.min("logical_day").alias("logical_day")), graph.node_types(node_definitions(spark, sf)))
    member, evidence = fmg.memberships(nodes), fmg.witnesses(graph.compress(edges, "pg_id"))
    cont = fmg.continuations(pgs.select("pg_id", "start_ns", "end_ns"), member, fmg.occurrences(evidence), DAY_NS)
    return member, evidence, pgs, fmg.direct(evidence, member).unionByName(cont)


@query(f"{LEAF_FMG} SELECT * FROM lrel")
def leaf_fmg_edges(spark, sf):
    """Relations between communities of cut intervals: split continuations inside a day, entity continuations across days."""
    return fmg.relations(_leaf_fmg(spark, sf)[3])


@query(f"{LEAF_FMG}, allw AS (SELECT * FROM dir UNION ALL SELECT * FROM cont) SELECT 'fmg-' || substr(sha256(edge_type || chr(0) || src_community_id || chr(0) || dst_community_id), 1, 24) AS fmg_edge_id, row_number() OVER (PARTITION BY src_community_id, dst_community_id, edge_type ORDER BY ts, x.evidence_id, side, entity_uuid) - 1 AS witness_index, side, x.evidence_id, ts AS timestamp_ns, entity_uuid, lc.pg_id, lc.src_uuid, lc.dst_uuid, first_event_uuid AS event_uuid, lc.event_type, CAST(predicate_index AS INT) AS predicate_index, event_count, 0 AS raw_shard, f[2] AS raw_line FROM allw x JOIN lc ON x.evidence_id = 'event:' || first_event_uuid || ':p' || predicate_index")
def witness_records(spark, sf):
    """Every witness with the whole record of its evidence."""
    _, evidence, _, w = _leaf_fmg(spark, sf)
    return fmg.witness_records(fmg.indexed(w), evidence).drop("raw_offset")


@query(f"{LEAF_FMG} SELECT community_id, min((ts, evidence_id))[1] AS timestamp_ns, min((ts, evidence_id))[2] AS evidence_id FROM (SELECT pg_id, unnest([src_uuid, dst_uuid]) AS node_uuid, ts, evidence_id FROM wit) x JOIN lm USING (pg_id, node_uuid) GROUP BY community_id")
def community_evidence(spark, sf):
    member, evidence, _, _ = _leaf_fmg(spark, sf)
    # equal times are decided by the place in the log, which grows with time in these events
    return fmg.community_evidence(evidence.withColumn("first_raw_offset", F.lit(0)), member)


@query(f"{LEAF_FMG} SELECT pg_id, node_uuid FROM (SELECT DISTINCT pg_id, unnest([src_uuid, dst_uuid]) AS node_uuid FROM wit) ANTI JOIN lm USING (pg_id, node_uuid)")
def unknown_members(spark, sf):
    """A check: no edge may end at a node without a community."""
    member, evidence, _, _ = _leaf_fmg(spark, sf)
    return fmg.unknown_members(evidence, member)


@query(f"{FMG} SELECT * FROM rel")
def incremental_fmg(spark, sf):
    """The memory graph of whole days, inserted in three parts: the last days, then the first, then those between."""
    member = settled(_fmg(spark, sf)[0])
    witness = settled(fmg.witnesses(graph.compress(graph.edges(_day(events(spark, sf))), "pg_id", "logical_day")))
    start = (F.col("logical_day") - 1).cast("long") * DAY_NS + FIRST_DAY_NS
    state = None
    for part in ("logical_day > 20", "logical_day <= 8", "logical_day between 9 and 20"):
        mine = member.where(part).select("pg_id", "node_uuid", "community_id", "logical_day")
        pgs = mine.select("pg_id", start.alias("start_ns"), (start + DAY_NS).alias("end_ns")).distinct()
        state = incremental.insert(state, pgs, mine.drop("logical_day"), witness.where(part).drop("logical_day"), DAY_NS)
    return fmg.relations(state.witnesses())


@query("SELECT CAST(o_orderkey AS VARCHAR) AS pg_id, start_ns, end_ns, busy_until FROM (SELECT *, max(end_ns) OVER (ORDER BY start_ns, end_ns, CAST(o_orderkey AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) * 100 AS start_ns, CAST(o_custkey AS BIGINT) * 100 + 50 + o_orderkey % 90 AS end_ns FROM orders WHERE o_orderkey % 40 = 0)) WHERE start_ns < busy_until")
def overlapping_intervals(spark, sf):
    """Intervals made from some orders that overlap one before them."""
    o = table(spark, sf, "orders").where("o_orderkey % 40 = 0")
    start = F.col("o_custkey").cast("long") * 100
    return fmg.overlapping(o.select(F.col("o_orderkey").cast("string").alias("pg_id"), start.alias("start_ns"), (start + 50 + F.col("o_orderkey") % 90).alias("end_ns")))




def _coi_sql() -> str:
    """Candidates: communities with their anchors, carriers (a tenth of them over the threshold), flows out and scores."""
    roles = ALL_SCORES.split(", roles AS", 1)[1]
    pieces = f"{FMG}, roles AS{roles}, {PERCENTILE}"
    return f"""{pieces}, sel AS (SELECT logical_day, node_uuid, q, CASE WHEN q >= 0.99 THEN 'anchor' WHEN q >= 0.95 THEN 'context_carrier' END AS role FROM pct),
up AS (SELECT community_id, any_value(m.logical_day) AS logical_day, count(*) AS node_count, coalesce(max(q), 0.0) AS max_percentile, count(*) FILTER (role = 'anchor') AS anchor_count, count(*) FILTER (role = 'context_carrier') AS context_carrier_count, coalesce(max(q) FILTER (role = 'anchor'), 0.0) AS max_anchor_score, coalesce(max(q) FILTER (role = 'context_carrier'), 0.0) AS max_carrier_score FROM member m LEFT JOIN sel ON sel.logical_day = m.logical_day AND sel.node_uuid = m.node_uuid GROUP BY community_id),
coi AS (SELECT up.*, coalesce(n, 0) AS boundary_flow_count, {FIRST_DAY_NS} + (logical_day - 1) * {DAY_NS} AS start_ns FROM up LEFT JOIN (SELECT src_community_id AS community_id, count(*) AS n FROM rel GROUP BY 1) USING (community_id))"""


COI = _coi_sql()
KEY = "CASE WHEN anchor_count > 0 THEN 0 ELSE 1 END, boundary_flow_count DESC, max_anchor_score DESC, max_carrier_score DESC, start_ns, {id}"


def _selected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = _day(_percentiles(spark, sf)).select("pg_id", "node_uuid", "q")
    role = F.when(F.col("q") >= 0.99, "anchor").when(F.col("q") >= 0.95, "context_carrier")
    return q, q.withColumn("role", role).where("role is not null")


def _candidates(spark: SparkSession, sf: str, member: DataFrame, relation: DataFrame) -> DataFrame:
    q, some = _selected(spark, sf)
    rows = member.select("pg_id", "node_uuid", "community_id", "logical_day").join(some, ["pg_id", "node_uuid"], "left")
    best = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("q"))), F.lit(0.0))
    up = rows.groupBy("community_id").agg(F.count_if(F.col("role") == "anchor").alias("anchor_count"), best("anchor").alias("max_anchor_score"), best("context_carrier").alias("max_carrier_score"), ((F.min("logical_day") - 1).cast("long") * DAY_NS + FIRST_DAY_NS).alias("start_ns"))
    flows = relation.groupBy(F.col("src_community_id").alias("community_id")).agg(F.count(F.lit(1)).alias("boundary_flow_count"))
    return up.join(flows, "community_id", "left").na.fill(0, ["boundary_flow_count"])


@query(f"{COI} SELECT community_id, node_count, round(max_percentile, 6) AS max_percentile, anchor_count, context_carrier_count FROM up")
def community_rollup(spark, sf):
    return fmg.rolled_up(_fmg(spark, sf)[0], *_selected(spark, sf)).withColumn("max_percentile", F.round("max_percentile", 6))


@query(f"{COI} SELECT community_id, row_number() OVER (ORDER BY {KEY.format(id='community_id')}) AS schedule_rank FROM coi")
def rank_coi(spark, sf):
    member, _, w = _fmg(spark, sf)
    return fmg.ranked_communities(_candidates(spark, sf, member, fmg.relations(w))).select("community_id", "schedule_rank")


@query(f"{COI}, n AS (SELECT rel.*, row_number() OVER (PARTITION BY src_community_id ORDER BY CASE evidence_semantics WHEN 'causal_event' THEN 0 ELSE 1 END, {KEY.format(id='dst_community_id')}, fmg_edge_id) AS rank FROM rel JOIN coi ON coi.community_id = dst_community_id) SELECT src_community_id, dst_community_id, fmg_edge_id, rank FROM n WHERE rank <= 3")
def forward_neighborhood(spark, sf):
    member, _, w = _fmg(spark, sf)
    relation = fmg.relations(w)
    return fmg.forward_neighborhood(relation, _candidates(spark, sf, member, relation))


@query(f"{FMG}, ent AS (SELECT DISTINCT 'fmg-' || substr(sha256(edge_type || chr(0) || src_community_id || chr(0) || dst_community_id), 1, 24) AS fmg_edge_id FROM cont WHERE entity_uuid IN (SELECT md5('o' || k) FROM range(40) AS r(k))) SELECT src_community_id, dst_community_id, fmg_edge_id, first_witness_ns, row_number() OVER (PARTITION BY src_community_id ORDER BY first_witness_ns, dst_community_id, fmg_edge_id) AS rank FROM rel SEMI JOIN ent USING (fmg_edge_id) WHERE evidence_semantics = 'identity_continuity' AND CAST(substr(src_community_id, 2, 2) AS INT) % 2 = 1 AND NOT dst_community_id LIKE '%:c00002'")
def core_continuations(spark, sf):
    """From communities of odd days, along the objects 0 to 39, to communities other than those of directories."""
    member, _, w = _fmg(spark, sf)
    entity = w.where("entity_uuid is not null").select(fmg.edge_id(F.col("edge_type"), F.col("src_community_id"), F.col("dst_community_id")).alias("fmg_edge_id"), "entity_uuid").distinct()
    frontier = member.where("logical_day % 2 = 1").select("community_id").distinct()
    core = spark.range(40).select(F.md5(F.concat(F.lit("o"), F.col("id").cast("string"))).alias("entity_uuid"))
    return fmg.core_continuations(fmg.relations(w), entity, frontier, core, member.where("community_id like '%:c00002'").select("community_id").distinct())


@query(f"{FMG} SELECT src_community_id, dst_community_id, fmg_edge_id, edge_type, evidence_semantics FROM (SELECT *, row_number() OVER (PARTITION BY src_community_id, dst_community_id ORDER BY evidence_semantics <> 'causal_event', edge_type <> 'entity_lineage', fmg_edge_id) AS o FROM rel) WHERE o = 1")
def backbone_transitions(spark, sf):
    return fmg.backbone_transitions(fmg.relations(_fmg(spark, sf)[2]))


GAPS = f"com AS (SELECT DISTINCT community_id, logical_day, {FIRST_DAY_NS} + (logical_day - 1) * {DAY_NS} AS start_ns FROM member), gap AS (SELECT DISTINCT a.community_id || '>' || b.community_id AS gap_id, a.community_id AS left_id, CASE WHEN b.logical_day % 5 = 0 THEN 'ghost' ELSE b.community_id END AS right_id FROM com a JOIN com b ON b.logical_day = a.logical_day + 1)"


@query(f"""{FMG}, {GAPS}, x AS (SELECT gap.*, l.start_ns AS ls, r.start_ns AS rs, EXISTS (SELECT 1 FROM rel WHERE src_community_id = left_id AND dst_community_id = right_id) AS d FROM gap LEFT JOIN com l ON l.community_id = left_id LEFT JOIN com r ON r.community_id = right_id), y AS (SELECT *, CASE WHEN ls IS NULL OR rs IS NULL THEN 'unknown_endpoint' WHEN d THEN 'direct_relation_exists' END AS error FROM x)
SELECT gap_id, left_id, right_id, error, CASE WHEN error IS NULL THEN least(ls, rs) END AS min_start_ns, CASE WHEN error IS NULL THEN greatest(ls, rs) + {DAY_NS} END AS max_end_ns FROM y""")
def bridge_queries(spark, sf):
    """Gaps between all communities of a day and the next; on days divisible by five the right end does not exist."""
    member, _, w = _fmg(spark, sf)
    start = (F.col("logical_day") - 1).cast("long") * DAY_NS + FIRST_DAY_NS
    com = member.select("community_id", "logical_day", start.alias("start_ns"), (start + DAY_NS).alias("end_ns")).distinct()
    left, right = com.select(F.col("community_id").alias("left_id"), (F.col("logical_day") + 1).alias("day")), com.select(F.col("community_id").alias("r"), F.col("logical_day").alias("day"))
    gaps = left.join(right, "day").select(F.concat("left_id", F.lit(">"), "r").alias("gap_id"), "left_id", F.when(F.col("day") % 5 == 0, "ghost").otherwise(F.col("r")).alias("right_id"))
    return fmg.bridge_queries(gaps.distinct(), com, fmg.relations(w))


PATHS = """r AS (SELECT *, CASE evidence_semantics WHEN 'causal_event' THEN 1 ELSE 0 END AS c FROM rel), p AS (SELECT a.src_community_id AS left_id, a.dst_community_id AS middle_id, b.dst_community_id AS right_id, a.fmg_edge_id AS first_edge, b.fmg_edge_id AS second_edge, a.c + b.c AS k FROM r a JOIN r b ON b.src_community_id = a.dst_community_id WHERE a.src_community_id <> b.dst_community_id AND NOT EXISTS (SELECT 1 FROM rel x WHERE x.src_community_id = a.src_community_id AND x.dst_community_id = b.dst_community_id)), n AS (SELECT *, row_number() OVER (PARTITION BY left_id, right_id ORDER BY k DESC, middle_id, first_edge, second_edge) AS rank FROM p)"""


@query(f"""{FMG}, {PATHS} SELECT left_id || '|' || right_id || '|' || rank AS candidate_id, concat_ws(',', CASE WHEN rank % 2 = 0 THEN 'query_id_mismatch' END, CASE WHEN rank % 7 = 0 THEN 'left_endpoint_mismatch' END, CASE WHEN rank % 3 = 0 THEN 'excluded_intermediate' END, CASE WHEN rank % 5 = 0 THEN 'unknown_edge' END, CASE WHEN rank % 5 <> 0 AND rank % 4 = 0 AND first_edge <> second_edge THEN 'first_edge_path_mismatch' END, CASE WHEN rank % 5 <> 0 AND rank % 6 = 0 THEN 'missing_witness' END) AS errors FROM n""")
def bridge_errors(spark, sf):
    """All bridges, spoiled by their rank in ways that the check must name."""
    relation = fmg.relations(_fmg(spark, sf)[2])
    k = F.col("rank")
    c = fmg.bridges(relation).select(
        F.concat_ws("|", "left_id", "right_id", k.cast("string")).alias("candidate_id"), F.when(k % 2 == 0, "other").otherwise("q").alias("query_id"), F.lit("q").alias("asked_id"), F.when(k % 7 == 0, "elsewhere").otherwise(F.col("left_id")).alias("left_id"), "right_id",
        F.array("left_id", "middle_id", "right_id").alias("path"), F.array(F.when(k % 4 == 0, F.col("second_edge")).otherwise(F.col("first_edge")), F.when(k % 5 == 0, "nothing").otherwise(F.col("second_edge"))).alias("edges"),
        F.when(k % 3 == 0, F.array("middle_id")).otherwise(F.array().cast("array<string>")).alias("excluded"), F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("w"))).alias("witness_ids"),
    )
    return fmg.bridge_errors(c, relation).select("candidate_id", F.array_join("errors", ",").alias("errors"))


# Entities of assessments: objects 2, 6, 10, ... are flows, with outside, private and documentation addresses in turn; users whose id begins with 00 are unknown.
ENTITIES = """ent AS (SELECT nt.node_uuid AS entity_id, entity_type, CASE WHEN entity_type = 'NET_FLOW' THEN k % 12 = 2 ELSE FALSE END AS external, CASE WHEN k % 8 = 2 THEN 80 ELSE 22 END AS local_port FROM nt LEFT JOIN (SELECT md5('o' || k) AS node_uuid, k FROM range(100) AS r(k)) USING (node_uuid) WHERE NOT nt.node_uuid LIKE '00%')"""
ATOMS = """atoms AS (SELECT CAST(logical_day AS VARCHAR) || substr(subject_uuid, 1, 1) AS scope_id, src_uuid AS src, dst_uuid AS dst, CASE WHEN event_type = 'EVENT_READ' THEN 'EVENT_RECVFROM' ELSE event_type END AS event_type, timestamp_ns, event_uuid AS evidence_id, 'c' || logical_day AS community_id FROM edges WHERE predicate_index = 1)"""


def _assessment_sql(callback: int | None, effect: int | None) -> str:
    bounded = callback is not None
    reasons = control.HORIZON_REASONS if bounded else control.SCOPE_REASONS
    order = "rank DESC, ts, id DESC" if bounded else "rank DESC, ts, id"
    upto = f"AND c.timestamp_ns <= i.ts + {callback}" if bounded else ""
    until = f"AND x.timestamp_ns <= i.ts + {effect}" if bounded else ""
    return f"""{LEAVES}, {ENTITIES}, {ATOMS}, a AS (SELECT atoms.*, s.entity_type AS st, d.entity_type AS dt, s.external AS sx, d.external AS dx, s.local_port AS sp FROM atoms LEFT JOIN ent s ON s.entity_id = src LEFT JOIN ent d ON d.entity_id = dst), bad AS (SELECT scope_id, string_agg(evidence_id, ',' ORDER BY evidence_id) AS ids FROM a WHERE st IS NULL OR dt IS NULL GROUP BY 1),
i AS (SELECT scope_id, src AS flow, dst AS who, timestamp_ns AS ts, evidence_id AS id, community_id AS com FROM a WHERE event_type = 'EVENT_RECVFROM' AND sx AND sp IN (80, 443) AND dt = 'SUBJECT_PROCESS'),
cb AS (SELECT i.id, min((c.timestamp_ns, c.evidence_id)) AS m FROM i JOIN a c ON c.scope_id = i.scope_id AND c.src = i.who AND c.event_type = 'EVENT_SENDTO' AND c.dx AND c.timestamp_ns >= i.ts {upto} GROUP BY 1),
ef AS (SELECT i.id, min((w.timestamp_ns, w.evidence_id, x.timestamp_ns, x.evidence_id, x.dst)) AS m FROM i JOIN a w ON w.scope_id = i.scope_id AND w.src = i.who AND w.event_type = 'EVENT_WRITE' AND w.dt LIKE 'FILE_OBJECT%' AND w.timestamp_ns >= i.ts JOIN a x ON x.scope_id = i.scope_id AND x.src = w.dst AND x.event_type = 'EVENT_EXECUTE' AND x.dt = 'SUBJECT_PROCESS' AND x.timestamp_ns >= w.timestamp_ns {until} GROUP BY 1),
r AS (SELECT i.*, cb.m AS c, ef.m AS e, 1 + (cb.m IS NOT NULL)::INT + (ef.m IS NOT NULL)::INT AS rank FROM i LEFT JOIN cb USING (id) LEFT JOIN ef USING (id)), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY {order}) AS o FROM r) WHERE o = 1),
s AS (SELECT DISTINCT scope_id FROM atoms), f AS (SELECT s.scope_id, bad.ids, b.* EXCLUDE (scope_id) FROM s LEFT JOIN bad USING (scope_id) LEFT JOIN b USING (scope_id))
SELECT scope_id, CASE WHEN ids IS NOT NULL THEN 'conflicted' WHEN id IS NULL THEN 'absent' ELSE ['attempted', 'probable', 'supported'][rank] END AS status, CASE WHEN ids IS NULL THEN who END AS entry_subject_id, CASE WHEN ids IS NULL THEN flow END AS entry_flow_id, CASE WHEN ids IS NULL THEN coalesce(e[5], who) END AS first_local_subject_id, CASE WHEN ids IS NULL AND id IS NOT NULL THEN com ELSE '' END AS community_ids,
coalesce(ids, CASE WHEN id IS NULL THEN '' ELSE array_to_string(list_sort(list_filter([id, c[2], e[2], e[4]], lambda v: v IS NOT NULL)), ',') END) AS evidence_ids, CASE WHEN ids IS NOT NULL THEN 'invalid_evidence_reference' WHEN id IS NULL THEN 'no_boundary_ingress' ELSE {list(reasons)}[rank] END AS reason_codes FROM f"""


def _assessed(spark: SparkSession, sf: str, callback: int | None, effect: int | None) -> DataFrame:
    k = F.col("id")
    address = F.when(k % 12 == 2, F.concat(F.lit("8.8.4."), k)).when(k % 12 == 6, F.concat(F.lit("10.0.0."), k)).otherwise(F.concat(F.lit("203.0.113."), k))
    flows = spark.range(100).select(F.md5(F.concat(F.lit("o"), k.cast("string"))).alias("node_uuid"), address.alias("remote_address"), F.when(k % 8 == 2, 80).otherwise(22).alias("local_port"))
    ent = graph.node_types(node_definitions(spark, sf)).where("node_uuid not like '00%'").join(flows, "node_uuid", "left")
    ent = ent.select(F.col("node_uuid").alias("entity_id"), "entity_type", control.external_flow(F.col("entity_type"), F.col("remote_address")).alias("external"), F.coalesce("local_port", F.lit(22)).alias("local_port"))
    e = graph.edges(events(spark, sf)).where("predicate_index = 1")
    atoms = e.select(F.concat(F.col("logical_day").cast("string"), F.substring("subject_uuid", 1, 1)).alias("scope_id"), F.col("src_uuid").alias("src"), F.col("dst_uuid").alias("dst"), F.when(F.col("event_type") == "EVENT_READ", "EVENT_RECVFROM").otherwise(F.col("event_type")).alias("event_type"), "timestamp_ns", F.col("event_uuid").alias("evidence_id"), F.concat(F.lit("c"), F.col("logical_day").cast("string")).alias("community_id"))
    out = control.assessment(atoms, ent, callback_ns=callback, effect_ns=effect)
    return out.select("scope_id", "status", "entry_subject_id", "entry_flow_id", "first_local_subject_id", F.array_join("community_ids", ",").alias("community_ids"), F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("reason_codes", ",").alias("reason_codes"))


@query(_assessment_sql(6 * HOUR, 12 * HOUR))
def ic_horizon(spark, sf):
    return _assessed(spark, sf, 6 * HOUR, 12 * HOUR)


@query(_assessment_sql(None, None))
def ic_scope(spark, sf):
    return _assessed(spark, sf, None, None)


@query("""WITH a AS (SELECT c_custkey, c_custkey % 224 AS o1, c_custkey * 7 % 256 AS o2, c_custkey * 13 % 256 AS o3, c_custkey * 31 % 256 AS o4 FROM customer) SELECT c_custkey, NOT (o1 IN (0, 10, 127) OR (o1 = 169 AND o2 = 254) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168) OR (o1 = 192 AND o2 = 0 AND o3 = 2) OR (o1 = 192 AND o2 = 0 AND o3 = 0 AND o4 NOT IN (9, 10)) OR (o1 = 198 AND o2 IN (18, 19)) OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113) OR o1 = 100) AS external FROM a""")
def external_flows(spark, sf):
    """Flows with an address made from each customer's key; 100.0.0.0/8 is local."""
    c = F.col("c_custkey")
    address = F.concat_ws(".", *((x % m).cast("string") for x, m in ((c, 224), (c * 7, 256), (c * 13, 256), (c * 31, 256))))
    return table(spark, sf, "customer").select("c_custkey", control.external_flow(F.lit("NET_FLOW"), address, ("100.0.0.0/8",)).alias("external"))


FRONTIERS = """f AS (SELECT l_orderkey AS state_id, l_linenumber || '-' || l_partkey AS frontier_id, ['validation', 'connectivity', 'entry'][1 + l_partkey % 3] AS kind, 'r' || l_suppkey AS reason, l_returnflag = 'R' AND l_partkey % 4 <> 0 AS open FROM lineitem), o AS (SELECT state_id, min((kind, frontier_id))[2] AS first_id, count(*) AS n, min((frontier_id, reason)) FILTER (kind = 'validation') AS v, min((frontier_id, reason)) FILTER (kind = 'connectivity') AS c, min((frontier_id, reason)) FILTER (kind = 'entry') AS e FROM f WHERE open GROUP BY 1),
s AS (SELECT o_orderkey AS state_id, ['supported', 'supported', 'probable', 'absent', 'conflicted'][1 + o_orderkey % 5] AS ic, o_custkey % 2 = 0 AS earlier, o_custkey % 4 AS rest, o_custkey % 3 <> 0 AS conn, o_custkey % 7 <> 0 AS wit FROM orders)"""


@query(f"""WITH {FRONTIERS}, j AS (SELECT s.*, n, first_id, v, c, e FROM s LEFT JOIN o USING (state_id)), d AS (SELECT state_id, CASE WHEN ic = 'supported' AND conn AND wit AND n IS NULL THEN ['terminate', 'entry_boundary_resolved', NULL, 't'] WHEN rest <= 0 THEN ['suspend', 'action_budget_exhausted', first_id, 't'] WHEN ic = 'conflicted' OR v IS NOT NULL THEN ['continue', 'bounded_verification_required', v[1], 'f'] WHEN c IS NOT NULL THEN ['retrieve_bridge', c[2], c[1], 'f']
WHEN NOT wit THEN ['suspend', 'unmaterialized_connectivity_frontier', NULL, 't'] WHEN ic <> 'supported' AND earlier THEN ['extend_left', 'entry_boundary_unresolved', e[1], 'f'] WHEN ic <> 'supported' THEN ['suspend', 'earlier_evidence_unavailable', e[1], 't'] WHEN NOT conn THEN ['suspend', 'supported_entry_not_connected_to_backbone', NULL, 't'] WHEN e IS NOT NULL THEN ['suspend', 'inconsistent_open_entry_frontier', e[1], 't'] ELSE ['suspend', 'unresolved_investigation_state', NULL, 't'] END AS d FROM j)
SELECT state_id, d[1] AS action, d[2] AS reason, d[3] AS frontier_id, d[4] = 't' AS terminal FROM d""")
def decide_v7(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_custkey")
    statuses = F.array(*map(F.lit, ("supported", "supported", "probable", "absent", "conflicted")))
    states = o.select(F.col("o_orderkey").alias("state_id"), F.element_at(statuses, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("ic_status"), (k % 2 == 0).alias("earlier_scope"), (k % 4).alias("remaining"), (k % 3 != 0).alias("entry_connected"), (k % 7 != 0).alias("transitions_witnessed"))
    part = F.col("l_partkey")
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("state_id"), F.concat_ws("-", F.col("l_linenumber").cast("string"), part.cast("string")).alias("frontier_id"), F.element_at(F.array(*map(F.lit, ("validation", "connectivity", "entry"))), (part % 3 + 1).cast("int")).alias("kind"), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("reason"), (part % 4 != 0).alias("critical"), F.when(F.col("l_returnflag") == "R", "open").otherwise("resolved").alias("status"))
    return control.decide(states, items)


KINDS = ("evidence_integrity", "connectivity", "entry", "stage_constraint", "left_time", "right_time", "host_scope", "competition", "odd")
SIDES = ("left", "right", "host", "none")


def _next_sql() -> str:
    room = "CASE {d} WHEN 'left' THEN l WHEN 'right' THEN g WHEN 'host' THEN h ELSE FALSE END"
    firsts = ", ".join(f"min((item, why, side)) FILTER (k = '{k}') AS {k}" for k in KINDS[:-1])
    gaps = " ".join(f"WHEN {k} IS NOT NULL AND {room.format(d=f'{k}[3]')} THEN ['{a}', {k}[2], {k}[1], 'f'] WHEN {k} IS NOT NULL THEN ['stop_limited', 'frontier_scope_unavailable', {k}[1], 't']" for k, a in control.SCOPE_GAPS.items())
    return f"""WITH s AS (SELECT o_orderkey AS state_id, ['supported', 'supported', 'supported', 'probable', 'absent', 'conflicted'][1 + o_orderkey % 6] AS st, o_custkey % 6 AS r, o_custkey % 2 = 0 AS l, o_custkey % 3 = 0 AS g, o_custkey % 5 = 0 AS h FROM orders), i AS (SELECT l_orderkey AS state_id, CAST(l_linenumber AS VARCHAR) AS item, {list(KINDS)}[1 + l_partkey % 9] AS k, {list(SIDES)}[1 + l_suppkey % 4] AS side, 'why' || l_suppkey AS why FROM lineitem WHERE l_returnflag = 'R'),
f AS (SELECT state_id, min((item, why)) AS a, {firsts} FROM i GROUP BY 1), j AS (SELECT * FROM s LEFT JOIN f USING (state_id)), d AS (SELECT state_id, CASE WHEN a IS NULL AND st = 'supported' THEN ['stop_complete', 'ic_supported_and_frontier_closed', NULL, 't'] WHEN r <= 0 THEN ['stop_limited', 'action_budget_exhausted', a[1], 't'] WHEN st = 'conflicted' OR evidence_integrity IS NOT NULL THEN ['verify_claim', 'invalid_or_conflicting_evidence', evidence_integrity[1], 'f'] WHEN connectivity IS NOT NULL THEN ['retrieve_bridge', connectivity[2], connectivity[1], 'f']
WHEN st = 'absent' AND l THEN ['extend_left', 'entry_not_observed', entry[1], 'f'] WHEN st = 'absent' AND h THEN ['extend_host', 'entry_may_be_cross_host', entry[1], 'f'] WHEN st = 'absent' THEN ['stop_limited', 'entry_evidence_unavailable', entry[1], 't'] WHEN st = 'probable' AND g THEN ['extend_right', 'entry_success_not_yet_evidenced', entry[1], 'f'] WHEN st = 'probable' THEN ['stop_limited', 'entry_consequence_unavailable', entry[1], 't']
WHEN stage_constraint IS NOT NULL AND (stage_constraint[3] = 'none' OR {room.format(d='stage_constraint[3]')}) THEN [CASE WHEN stage_constraint[3] = 'none' THEN 'verify_claim' ELSE 'extend_' || stage_constraint[3] END, stage_constraint[2], stage_constraint[1], 'f'] WHEN stage_constraint IS NOT NULL THEN ['stop_limited', 'stage_evidence_unavailable', stage_constraint[1], 't'] {gaps}
WHEN competition IS NOT NULL THEN ['verify_claim', competition[2], competition[1], 'f'] WHEN a IS NOT NULL THEN ['verify_claim', a[2], a[1], 'f'] ELSE ['stop_limited', 'initial_compromise_not_supported', NULL, 't'] END AS d FROM j) SELECT state_id, d[1] AS action, d[2] AS reason, d[3] AS item_id, d[4] = 't' AS terminal FROM d"""


@query(_next_sql())
def next_action(spark, sf):
    """States from orders and open items of all kinds and directions from returned lines."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    r = F.col("o_custkey")
    states = table(spark, sf, "orders").select(F.col("o_orderkey").alias("state_id"), pick(("supported", "supported", "supported", "probable", "absent", "conflicted"), F.col("o_orderkey")).alias("ic_status"), (r % 6).alias("remaining"), (r % 2 == 0).alias("can_left"), (r % 3 == 0).alias("can_right"), (r % 5 == 0).alias("can_host"))
    items = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("state_id"), F.col("l_linenumber").cast("string").alias("item_id"), pick(KINDS, F.col("l_partkey")).alias("gap_type"), F.lit("open").alias("status"), F.lit(True).alias("critical"), pick(SIDES, F.col("l_suppkey")).alias("direction"), F.concat(F.lit("why"), F.col("l_suppkey").cast("string")).alias("reason"))
    return control.next_action(states, items)


@query("""WITH s AS (SELECT l_orderkey AS path_id, l_linenumber AS n, l_partkey % 2 AS src, l_suppkey % 2 AS dst, l_quantity > 5 AS w, l_returnflag = 'R' AND l_linestatus = 'F' AND l_tax > 0.06 AS bad, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos FROM lineitem), ids AS (SELECT path_id, [any_value(src) FILTER (pos = 0)] || list(dst ORDER BY pos) AS ids FROM s GROUP BY 1),
g AS (SELECT s.path_id, bool_and(src = ids[pos + 1] AND dst = ids[pos + 2]) AS connected, bool_and(w) AS witnessed, bool_and(NOT bad) AS causal FROM s JOIN ids USING (path_id) GROUP BY 1) SELECT *, connected AND witnessed AND causal AS valid, concat_ws(',', CASE WHEN NOT connected THEN 'entry_to_seed_path_disconnected' END, CASE WHEN NOT witnessed THEN 'unwitnessed_retained_edge' END, CASE WHEN NOT causal THEN 'identity_edge_promoted_to_attack_transition' END) AS reason_codes FROM g""")
def path_validation(spark, sf):
    """Lines of an order as steps of a path between two communities."""
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    promoted = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06)
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path_id"), pos.alias("position"), (F.col("l_partkey") % 2).alias("src"), (F.col("l_suppkey") % 2).alias("dst"), F.lit("attack_transition").alias("role"), F.when(promoted, "identity_continuity").otherwise("causal_event").alias("semantics"), F.when(F.col("l_quantity") > 5, 1).otherwise(0).alias("witnesses"))
    ends = steps.groupBy("path_id").agg(F.min_by("src", "position").alias("first"), F.array_sort(F.collect_list(F.struct("position", "dst"))).alias("d"))
    paths = ends.select("path_id", F.concat(F.array("first"), F.transform("d", lambda x: x["dst"])).alias("community_ids"))
    return control.path_validation(paths, steps).withColumn("reason_codes", F.array_join("reason_codes", ","))


CITED = "c AS (SELECT l_orderkey AS message_id, CASE WHEN l_linenumber % 2 = 0 THEN 'evidence' ELSE 'community' END AS kind, CAST(l_partkey AS VARCHAR) AS ref FROM lineitem)"


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.when(F.col("l_linenumber") % 2 == 0, "evidence").otherwise("community").alias("kind"), F.col("l_partkey").cast("string").alias("ref"))


@query(f"WITH {CITED}, p AS (SELECT CAST(p_partkey AS VARCHAR) AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'evidence' ELSE 'community' END AS kind FROM part), b AS (SELECT DISTINCT message_id, 'unknown_' || kind || ':' || ref AS e FROM c ANTI JOIN p USING (kind, ref)) SELECT message_id, coalesce(string_agg(e, ',' ORDER BY e), '') AS errors FROM (SELECT DISTINCT message_id FROM c) LEFT JOIN b USING (message_id) GROUP BY message_id")
def reference_gate(spark, sf):
    """References of each message (an order) to parts: even keys are evidence, odd ones communities."""
    p = table(spark, sf, "part").select(F.when(F.col("p_partkey") % 2 == 0, "evidence").otherwise("community").alias("kind"), F.col("p_partkey").cast("string").alias("ref"))
    return agents.reference_errors(_cited(spark, sf), p).withColumn("errors", F.array_join("errors", ","))


@query(f"WITH {CITED}, w AS (SELECT DISTINCT l_orderkey AS message_id, CAST(CASE WHEN l_suppkey % 2 = 0 THEN l_partkey ELSE l_partkey + 1 END AS VARCHAR) AS ref FROM lineitem WHERE l_quantity > 20), h AS (SELECT w.message_id, count(*) AS expected_count, count(d.ref) AS covered_count FROM w LEFT JOIN (SELECT DISTINCT message_id, ref FROM c) d ON d.message_id = w.message_id AND d.ref = w.ref GROUP BY 1) SELECT message_id, coalesce(expected_count, 0) AS expected_count, coalesce(covered_count, 0) AS covered_count, round(CASE WHEN expected_count > 0 THEN covered_count / expected_count ELSE 1.0 END, 6) AS recall FROM (SELECT DISTINCT message_id FROM c) LEFT JOIN h USING (message_id)")
def evidence_coverage(spark, sf):
    expected = table(spark, sf, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("message_id"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_partkey") + 1).cast("string").alias("ref"))
    return agents.evidence_coverage(_cited(spark, sf), expected).withColumn("recall", F.round("recall", 6))


def queries():
    from . import records, registry  # noqa: F401  (records registers its queries)

    return registry.queries()


def oracle_sql():
    from . import records, registry  # noqa: F401

    return registry.oracle_sql()
