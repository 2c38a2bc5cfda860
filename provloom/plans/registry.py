"""Registered queries of the provenance engine and their DuckDB oracles, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, features, fmg, graph, residual, scoring
from ..operators.shared import settled
from ..sources import adapter
from ..sources.adapter import DAY_NS, FIRST_DAY_NS, SQL_EVENTS, SQL_NODES, events, node_definitions, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
START, END = FIRST_DAY_NS + 2 * DAY_NS, FIRST_DAY_NS + 9 * DAY_NS
HOUR = 3_600_000_000_000


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


WITH = f"WITH {SQL_EVENTS.strip()}"
COMPRESSED = """comp AS (
  SELECT logical_day, src_uuid, dst_uuid, event_type, predicate_index, count(*) AS event_count, min(timestamp_ns) AS first_timestamp_ns, max(timestamp_ns) AS last_timestamp_ns,
    arg_min(event_uuid, (timestamp_ns, raw_line)) AS first_event_uuid, 0 AS first_raw_shard, arg_min(raw_line, (timestamp_ns, raw_line)) AS first_raw_line, arg_min(raw_offset, (timestamp_ns, raw_line)) AS first_raw_offset
  FROM edges WHERE src_uuid <> dst_uuid GROUP BY ALL)"""
TOUCH = """touch AS (
  SELECT * FROM (SELECT timestamp_ns, logical_day, event_type, r.role, CASE r.role WHEN 'subject' THEN subject_uuid WHEN 'predicate' THEN predicate_uuid ELSE predicate2_uuid END AS node_uuid FROM e, (VALUES ('subject'), ('predicate'), ('predicate2')) AS r(role)) WHERE node_uuid IS NOT NULL)"""
CELLS = f"""cells AS (
  SELECT DISTINCT d AS depth, {DAY_NS} // (1 << d) AS width, timestamp_ns // ({DAY_NS} // (1 << d)) AS cell, (timestamp_ns % ({DAY_NS} // (1 << d))) // ({DAY_NS} // (1 << d) // 2) AS half, node_uuid FROM touch, range(6) AS x(d)
), stat AS (SELECT depth, width, cell, count(DISTINCT node_uuid) AS node_count, count(DISTINCT node_uuid) > 120 AND width > {HOUR} AND count(DISTINCT half) = 2 AS splits FROM cells GROUP BY depth, width, cell
), leaf AS (SELECT 'pg-' || (cell * width) || '-' || (cell * width + width) AS pg_id, cell * width AS start_ns, cell * width + width AS end_ns, depth, width, cell, node_count FROM stat s
  WHERE NOT splits AND NOT EXISTS (SELECT 1 FROM stat u WHERE u.depth < s.depth AND u.cell = s.cell // (1 << (s.depth - u.depth)) AND NOT u.splits))"""
ROLES = """roles AS (
  SELECT logical_day, node_uuid, count_if(role = 'subject') AS subject_count, count_if(role = 'predicate') AS predicate_count, count_if(role = 'predicate2') AS predicate2_count,
    count_if(event_type = 'EVENT_EXECUTE') AS event_execute, count_if(event_type = 'EVENT_READ') AS event_read, count_if(event_type = 'EVENT_SENDTO') AS event_sendto, count_if(event_type = 'EVENT_WRITE') AS event_write,
    count_if(event_type IN ('EVENT_EXECUTE', 'EVENT_READ', 'EVENT_SENDTO', 'EVENT_WRITE')) AS event_count, max(timestamp_ns) - min(timestamp_ns) AS activity_span_ns, coalesce(max(gap), 0) AS max_gap_ns,
    round(CASE WHEN count(*) > 1 THEN (max(timestamp_ns) - min(timestamp_ns)) / (count(*) - 1) ELSE 0.0 END / 1e9, 9) AS mean_gap_s
  FROM (SELECT *, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY logical_day, node_uuid ORDER BY timestamp_ns) AS gap FROM touch) GROUP BY logical_day, node_uuid)"""
DEGREES = """deg AS (
  SELECT logical_day, node_uuid, count(i) AS in_degree, count(o) AS out_degree, count(DISTINCT n) AS unique_neighbor_count FROM (
    SELECT DISTINCT logical_day, src_uuid AS node_uuid, dst_uuid AS o, NULL AS i, dst_uuid AS n FROM edges WHERE src_uuid <> dst_uuid
    UNION ALL SELECT DISTINCT logical_day, dst_uuid, NULL, src_uuid, src_uuid FROM edges WHERE src_uuid <> dst_uuid) GROUP BY logical_day, node_uuid)"""
SCORES = """scores AS (
  SELECT r.logical_day, r.node_uuid, entity_type, CAST(event_count AS DOUBLE) / (1 + coalesce(unique_neighbor_count, 0)) AS score FROM roles r JOIN nt USING (node_uuid) LEFT JOIN deg USING (logical_day, node_uuid))"""
ALL_SCORES = f"{WITH}, {SQL_NODES.strip()}, {TOUCH}, {ROLES}, {DEGREES}, {SCORES}"
PERCENTILE = """ref AS (SELECT entity_type, score, count(*) AS m FROM scores WHERE logical_day BETWEEN 13 AND 18 GROUP BY ALL), cdf AS (SELECT entity_type, score, sum(m) OVER (PARTITION BY entity_type ORDER BY score) AS upto, sum(m) OVER (PARTITION BY entity_type) AS n FROM ref), pct AS (
  SELECT s.logical_day, s.node_uuid, s.entity_type, s.score, coalesce(max(c.upto), 0) / max(t.n) AS q FROM scores s JOIN (SELECT entity_type, sum(m) AS n FROM ref GROUP BY entity_type) t USING (entity_type) LEFT JOIN cdf c ON c.entity_type = s.entity_type AND c.score <= s.score WHERE s.logical_day > 18 GROUP BY s.logical_day, s.node_uuid, s.entity_type, s.score)"""
FMG = f"""{WITH}, {SQL_NODES.strip()}, {TOUCH}, {COMPRESSED}, member AS (
  SELECT DISTINCT logical_day, node_uuid, format('d{{:02d}}:day{{:02d}}:c{{:05d}}', logical_day, logical_day, CASE entity_type WHEN 'SUBJECT_PROCESS' THEN 0 WHEN 'FILE_OBJECT_FILE' THEN 1 WHEN 'FILE_OBJECT_DIR' THEN 2 WHEN 'NET_FLOW' THEN 4 WHEN 'UNNAMED_PIPE' THEN 6 ELSE 9 END) AS community_id FROM touch JOIN nt USING (node_uuid)
), wit AS (SELECT *, 'event:' || first_event_uuid || ':p' || predicate_index AS evidence_id, first_timestamp_ns AS ts FROM comp
), dir AS (SELECT s.community_id AS src_community_id, d.community_id AS dst_community_id, CASE WHEN event_type IN ('EVENT_FORK', 'EVENT_EXECUTE') THEN 'entity_lineage' ELSE 'provenance_reachability' END AS edge_type, ts, evidence_id, 'event' AS side, NULL AS entity_uuid
  FROM wit JOIN member s ON s.logical_day = wit.logical_day AND s.node_uuid = src_uuid JOIN member d ON d.logical_day = wit.logical_day AND d.node_uuid = dst_uuid WHERE s.community_id <> d.community_id
), occ AS (SELECT logical_day, node_uuid, min((ts, evidence_id)) AS f, max((ts, evidence_id)) AS l FROM (SELECT logical_day, src_uuid AS node_uuid, ts, evidence_id FROM wit UNION ALL SELECT logical_day, dst_uuid, ts, evidence_id FROM wit) GROUP BY ALL
), pairs AS (SELECT a.community_id AS src_community_id, b.community_id AS dst_community_id, a.node_uuid AS entity_uuid, oa.l AS l, ob.f AS f FROM member a JOIN member b ON b.node_uuid = a.node_uuid AND b.logical_day = a.logical_day + 1 JOIN occ oa ON oa.node_uuid = a.node_uuid AND oa.logical_day = a.logical_day JOIN occ ob ON ob.node_uuid = b.node_uuid AND ob.logical_day = b.logical_day WHERE oa.l[1] <= ob.f[1]
), cont AS (SELECT src_community_id, dst_community_id, 'entity_continuation' AS edge_type, l[1] AS ts, l[2] AS evidence_id, 'left' AS side, entity_uuid FROM pairs UNION ALL SELECT src_community_id, dst_community_id, 'entity_continuation', f[1], f[2], 'right', entity_uuid FROM pairs
), rel AS (SELECT 'fmg-' || substr(sha256(edge_type || chr(0) || src_community_id || chr(0) || dst_community_id), 1, 24) AS fmg_edge_id, src_community_id, dst_community_id, edge_type, count(*) AS witness_count, count(DISTINCT entity_uuid) AS witness_entity_count, min(ts) AS first_witness_ns, max(ts) AS last_witness_ns, CASE WHEN edge_type LIKE '%continuation' THEN 'identity_continuity' ELSE 'causal_event' END AS evidence_semantics, CASE WHEN edge_type LIKE '%continuation' THEN 'continues' ELSE 'before' END AS time_relation FROM (SELECT * FROM dir UNION ALL SELECT * FROM cont) GROUP BY src_community_id, dst_community_id, edge_type)"""


def _day(df: DataFrame) -> DataFrame:
    """Whole days as intervals."""
    return df.withColumn("pg_id", F.format_string("day%02d", F.col("logical_day")))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    r, d, t = graph.roles(graph.touches(ev), "logical_day"), graph.degrees(graph.edges(ev), "logical_day"), graph.node_types(node_definitions(spark, sf))
    return features.typed(r, t).join(d, ["logical_day", "node_uuid"], "left").select("logical_day", "node_uuid", "entity_type", (F.col("event_count").cast("double") / (1 + F.coalesce("unique_neighbor_count", F.lit(0)))).alias("score"))


def _percentiles(spark: SparkSession, sf: str) -> DataFrame:
    s = settled(_scores(spark, sf))  # reference and rows, read several times
    return scoring.empirical_percentile(s.where("logical_day between 13 and 18"), s.where("logical_day > 18"), "entity_type").where("q is not null")


def _fmg(spark: SparkSession, sf: str):
    ev = _day(events(spark, sf))
    witness = fmg.witnesses(graph.compress(graph.edges(ev), "pg_id"))
    nodes = features.typed(_day(graph.touches(ev).select("logical_day", "node_uuid").distinct()), graph.node_types(node_definitions(spark, sf)))
    member = fmg.memberships(nodes)
    start = (F.col("logical_day") - 1).cast("long") * DAY_NS + FIRST_DAY_NS
    pgs = nodes.select("pg_id", start.alias("start_ns"), (start + DAY_NS).alias("end_ns")).distinct()
    direct = fmg.direct(witness, member)
    cont = fmg.continuations(pgs, member, fmg.occurrences(witness), DAY_NS)
    return member, witness, direct.unionByName(cont)


@query(f"{WITH} SELECT event_uuid, timestamp_ns, event_type, subject_uuid FROM e WHERE timestamp_ns >= {START} AND timestamp_ns < {END} AND phase = 'fit'")
def scan_range(spark, sf):
    return graph.scan(events(spark, sf), START, END, "fit").select("event_uuid", "timestamp_ns", "event_type", "subject_uuid")


@query(f"{WITH} SELECT event_uuid, src_uuid, dst_uuid, event_type, CAST(predicate_index AS INT) AS predicate_index, timestamp_ns, raw_offset FROM edges")
def materialize_edges(spark, sf):
    return graph.edges(events(spark, sf)).select("event_uuid", "src_uuid", "dst_uuid", "event_type", "predicate_index", "timestamp_ns", "raw_offset")


@query(f"{WITH}, {COMPRESSED} SELECT * REPLACE (CAST(predicate_index AS INT) AS predicate_index) FROM comp")
def compress_edges(spark, sf):
    return graph.compress(graph.edges(events(spark, sf)), "logical_day")


@query(f"{WITH}, {COMPRESSED} SELECT src_uuid, dst_uuid, event_type, CAST(sum(event_count) AS BIGINT) AS event_count FROM comp GROUP BY ALL ORDER BY event_count DESC, src_uuid, dst_uuid, event_type LIMIT 10")
def busiest_edges(spark, sf):
    c = graph.compress(graph.edges(events(spark, sf)), "logical_day")
    return c.groupBy("src_uuid", "dst_uuid", "event_type").agg(F.sum("event_count").alias("event_count")).orderBy(F.desc("event_count"), "src_uuid", "dst_uuid", "event_type").limit(10)


@query(f"{WITH} SELECT flow_direction, count(*) AS n FROM e GROUP BY flow_direction")
def direction_counts(spark, sf):
    return events(spark, sf).groupBy("flow_direction").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT logical_day, phase, count(*) AS n FROM e GROUP BY logical_day, phase")
def logical_day_counts(spark, sf):
    return events(spark, sf).groupBy("logical_day", "phase").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT event_type, flow_direction, logical_day, count(*) AS n FROM e GROUP BY GROUPING SETS ((event_type), (flow_direction), (logical_day), ())")
def shard_manifest(spark, sf):
    return events(spark, sf).groupingSets([["event_type"], ["flow_direction"], ["logical_day"], []], "event_type", "flow_direction", "logical_day").agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH}, {TOUCH}, {CELLS} SELECT pg_id, start_ns, end_ns, CAST(depth AS INT) AS depth, node_count FROM leaf")
def pg_intervals(spark, sf):
    return graph.bisect(events(spark, sf)).select("pg_id", "start_ns", "end_ns", "depth", "node_count")


@query(f"{WITH}, {TOUCH}, {CELLS} SELECT pg_id, count(*) AS events, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, count(DISTINCT subject_uuid) AS subjects FROM e JOIN leaf ON timestamp_ns >= start_ns AND timestamp_ns < end_ns GROUP BY pg_id")
def pg_summary(spark, sf):
    ev = events(spark, sf)
    return graph.assign(ev, graph.bisect(ev)).groupBy("pg_id").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.countDistinct("subject_uuid").alias("subjects"))


@query(f"{WITH}, {SQL_NODES.strip()} SELECT node_uuid, definition_count, entity_type FROM nt")
def node_types(spark, sf):
    return graph.node_types(node_definitions(spark, sf)).drop("entity_type_id")


@query(f"{WITH}, {TOUCH}, {ROLES} SELECT * FROM roles")
def node_roles(spark, sf):
    return graph.roles(graph.touches(events(spark, sf)), "logical_day")


@query(f"{WITH}, {DEGREES} SELECT * FROM deg")
def degrees(spark, sf):
    return graph.degrees(graph.edges(events(spark, sf)), "logical_day")


@query(f"{WITH}, {COMPRESSED} SELECT logical_day, least(src_uuid, dst_uuid) AS a, greatest(src_uuid, dst_uuid) AS b, round(ln(1 + sum(event_count)), 6) AS weight FROM comp GROUP BY ALL")
def community_weights(spark, sf):
    return graph.undirected_weights(graph.compress(graph.edges(events(spark, sf)), "logical_day"), "logical_day")


@query("""WITH c AS (SELECT event_type, median(value) AS center FROM events GROUP BY event_type), s AS (SELECT event_type, any_value(center) AS center, 1.4826 * median(abs(value - center)) AS scale FROM events JOIN c USING (event_type) GROUP BY event_type)
SELECT event_type, round(center, 6) AS center, round(CASE WHEN scale > 1e-6 THEN scale ELSE coalesce((SELECT median(scale) FROM s WHERE scale > 1e-6), 1.0) END, 6) AS scale FROM s""")
def median_mad(spark, sf):
    return scoring.median_mad(table(spark, sf, "events"), "event_type", "value")


@query(f"{ALL_SCORES}, {PERCENTILE} SELECT logical_day, node_uuid, entity_type, round(score, 6) AS score, round(q, 6) AS q FROM pct")
def cdf_percentile(spark, sf):
    return _percentiles(spark, sf).select("logical_day", "node_uuid", "entity_type", F.round("score", 6).alias("score"), F.round("q", 6).alias("q"))


@query(f"{ALL_SCORES} SELECT logical_day, node_uuid, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.0 END, 6) AS scaled FROM scores WINDOW w AS (PARTITION BY logical_day)")
def pg_minmax(spark, sf):
    return scoring.minmax(_scores(spark, sf), "logical_day").select("logical_day", "node_uuid", F.round("scaled", 6).alias("scaled"))


@query(f"""{ALL_SCORES}, {PERCENTILE}, b AS (SELECT *, least(256, CAST(ceil(CAST(0.075 AS DOUBLE) * count(*) OVER (PARTITION BY logical_day)) AS BIGINT)) AS budget FROM pct),
r AS (SELECT *, row_number() OVER (PARTITION BY logical_day ORDER BY q DESC, node_uuid) AS rank FROM b WHERE q >= 0.95) SELECT logical_day, node_uuid, round(q, 6) AS q, rank, CASE WHEN q >= 0.99 THEN 'anchor' ELSE 'context_carrier' END AS role FROM r WHERE rank <= budget""")
def select_per_pg(spark, sf):
    return scoring.select_per_scope(_percentiles(spark, sf), "logical_day").select("logical_day", "node_uuid", F.round("q", 6).alias("q"), "rank", "role")


@query(f"{ALL_SCORES}, r AS (SELECT logical_day, node_uuid, row_number() OVER (PARTITION BY logical_day ORDER BY score DESC, node_uuid) AS rank, count(*) OVER (PARTITION BY logical_day) AS n FROM scores) SELECT logical_day, node_uuid, rank FROM r WHERE rank <= greatest(1, ceil(n * CAST(0.05 AS DOUBLE)))")
def pg_top_fraction(spark, sf):
    return scoring.top_fraction(_scores(spark, sf), "logical_day").select("logical_day", "node_uuid", "rank")


@query(f"{FMG} SELECT format('day{{:02d}}', logical_day) AS pg_id, node_uuid, f[1] AS first_ns, f[2] AS first_evidence, l[1] AS last_ns, l[2] AS last_evidence FROM occ")
def occurrences(spark, sf):
    return fmg.occurrences(_fmg(spark, sf)[1])


@query(f"{FMG} SELECT * FROM rel")
def fmg_edges(spark, sf):
    return fmg.relations(_fmg(spark, sf)[2])


@query(f"{FMG}, allw AS (SELECT * FROM dir UNION ALL SELECT * FROM cont) SELECT 'fmg-' || substr(sha256(edge_type || chr(0) || src_community_id || chr(0) || dst_community_id), 1, 24) AS fmg_edge_id, row_number() OVER (PARTITION BY src_community_id, dst_community_id, edge_type ORDER BY ts, evidence_id, side, entity_uuid) - 1 AS witness_index, side, evidence_id, entity_uuid, ts AS timestamp_ns FROM allw")
def fmg_witnesses(spark, sf):
    return fmg.indexed(_fmg(spark, sf)[2])


_STEPS = "r AS (SELECT *, CASE evidence_semantics WHEN 'causal_event' THEN 1 ELSE 0 END AS c FROM rel), p AS (SELECT a.src_community_id AS left_id, a.dst_community_id AS middle_id, b.dst_community_id AS right_id, a.fmg_edge_id AS first_edge, b.fmg_edge_id AS second_edge, a.c + b.c AS k FROM r a JOIN r b ON b.src_community_id = a.dst_community_id WHERE a.src_community_id <> b.dst_community_id AND NOT EXISTS (SELECT 1 FROM rel x WHERE x.src_community_id = a.src_community_id AND x.dst_community_id = b.dst_community_id))"
_RANKED = "row_number() OVER (PARTITION BY left_id, right_id ORDER BY k DESC, middle_id, first_edge, second_edge) AS rank"
_PATH = "CASE k WHEN 2 THEN 'causal_path' WHEN 1 THEN 'mixed_path' ELSE 'identity_only' END AS path_class"


@query(f"{FMG}, {_STEPS} SELECT left_id, middle_id, right_id, first_edge, second_edge, {_PATH}, {_RANKED} FROM p")
def bridge_candidates(spark, sf):
    """All bridges between communities, whatever their time."""
    return fmg.bridges(fmg.relations(_fmg(spark, sf)[2]))


@query(f"""{FMG}, {_STEPS}, cd AS (SELECT DISTINCT community_id, logical_day FROM member), o AS (SELECT p.* FROM p JOIN cd l ON l.community_id = left_id JOIN cd m ON m.community_id = middle_id JOIN cd x ON x.community_id = right_id WHERE m.logical_day + 1 > least(l.logical_day, x.logical_day) AND m.logical_day < greatest(l.logical_day, x.logical_day) + 1
), ids AS (SELECT 'fmg-' || substr(sha256(edge_type || chr(0) || src_community_id || chr(0) || dst_community_id), 1, 24) AS edge, list(DISTINCT evidence_id) AS ids FROM (SELECT * FROM dir UNION ALL SELECT * FROM cont) GROUP BY ALL
), b AS (SELECT *, {_RANKED} FROM o) SELECT left_id, middle_id, right_id, first_edge, second_edge, {_PATH}, rank, len(list_distinct(f.ids || g.ids)) AS witnesses, sha256(array_to_string(list_sort(list_distinct(f.ids || g.ids)), ',')) AS witnesses_sha256 FROM b JOIN ids f ON f.edge = first_edge JOIN ids g ON g.edge = second_edge""")
def bridge_retrieval(spark, sf):
    """Every bridge whose middle overlaps the time of its ends, with how many witnesses its steps have and a digest of their sorted ids."""
    member, _, witness = _fmg(spark, sf)
    start = (F.col("logical_day") - 1).cast("long") * DAY_NS + FIRST_DAY_NS
    communities = member.select("community_id", start.alias("start_ns"), (start + DAY_NS).alias("end_ns")).distinct()
    out = fmg.bridges(fmg.relations(witness), communities, witness=witness)
    return out.withColumns({"witnesses": F.size("witness_ids").cast("long"), "witnesses_sha256": F.sha2(F.array_join("witness_ids", ","), 256)}).drop("witness_ids")


@query("SELECT epoch_us(time_bucket(INTERVAL 30 MINUTES, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_30m(spark, sf):
    """The batch form of the streaming query."""
    from ..streaming.forward import tumbling_counts

    return tumbling_counts(table(spark, sf, "events")).select(F.unix_micros("start").alias("start_us"), "event_type", F.col("count").alias("n"))


@query("""WITH d AS (SELECT o_orderpriority AS dataset, o_custkey % 97 AS depth, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT a.dataset, a.depth AS k, sum(b.n * abs(a.depth - b.depth)) / sum(b.n) AS m FROM d a JOIN d b USING (dataset) GROUP BY ALL)
SELECT dataset, CAST(k AS BIGINT) AS k, round(m, 6) AS mean_distance FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY m, k) AS o FROM c) WHERE o = 1""")
def fixed_depth(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 97).alias("depth"))
    return evaluation.fixed_depth(o, "dataset").withColumn("mean_distance", F.round("mean_distance", 6))


@query()
def graph_jaccard(spark, sf):
    """Days of each event type as true graphs, against days that begin twelve hours later."""
    def parts(shift: int):
        e = graph.edges(events(spark, sf)).withColumns({"run": F.col("event_type"), "graph_id": F.expr(f"cast((timestamp_ns + {shift}) div {DAY_NS} as string)")})
        start = F.col("graph_id").cast("long") * DAY_NS - shift
        graphs = e.select("run", "graph_id").distinct().select("run", "graph_id", start.alias("start_ns"), (start + DAY_NS).alias("end_ns"))
        return graphs, e.select("run", "graph_id", F.explode(F.array("src_uuid", "dst_uuid")).alias("item")), e.select("run", "graph_id", F.concat_ws(":", "src_uuid", "dst_uuid").alias("item"))

    (t, tn, te), (p, pn, pe) = parts(0), parts(12 * HOUR)
    return evaluation.graph_jaccard(t, p, tn, pn, te, pe)


@query()
def calibrated_residuals(spark, sf):
    """All rows, held against a fit on the rows of even orders."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("entity_type_id"), F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))).alias("residual"))
    old = F.col("l_orderkey") % 2 == 0
    return residual.calibrated(li.where(old), li, residual.shrinkage_models(li.where(old), n_min=128, pooled=True)).select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "q")


