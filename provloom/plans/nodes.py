"""Registered queries of node features, signatures, robust scores, evaluation and selection, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import term_search
from ..operators import features, graph, predictor, residual, scoring, traversal
from ..operators.shared import settled
from ..sources.adapter import DAY_NS, SQL_NODES, events, node_definitions, table
from ..sources.artifacts import event_type_fingerprint
from .registry import ALL_SCORES, CELLS, PERCENTILE, TOUCH, WITH, _percentiles, _scores, query

LEAVES = f"{WITH}, {SQL_NODES.strip()}, {TOUCH}, {CELLS}"
LEAF_ROWS = f"""lt AS (SELECT touch.*, leaf.pg_id, leaf.start_ns, leaf.end_ns FROM touch JOIN leaf ON timestamp_ns >= leaf.start_ns AND timestamp_ns < leaf.end_ns
), le AS (SELECT x.*, leaf.pg_id, leaf.start_ns, leaf.end_ns FROM edges x JOIN leaf ON timestamp_ns >= leaf.start_ns AND timestamp_ns < leaf.end_ns
), lc AS (SELECT pg_id, any_value(logical_day) AS logical_day, src_uuid, dst_uuid, event_type, predicate_index, count(*) AS event_count, min((timestamp_ns, raw_line)) AS f, arg_min(event_uuid, (timestamp_ns, raw_line)) AS first_event_uuid FROM le WHERE src_uuid <> dst_uuid GROUP BY pg_id, src_uuid, dst_uuid, event_type, predicate_index
), ld AS (SELECT pg_id, node_uuid, count(DISTINCT o) AS in_degree, 0 AS out_degree FROM (SELECT pg_id, dst_uuid AS node_uuid, src_uuid AS o FROM lc) GROUP BY ALL
), lo AS (SELECT pg_id, src_uuid AS node_uuid, count(DISTINCT dst_uuid) AS out_degree FROM lc GROUP BY ALL
), ln AS (SELECT pg_id, node_uuid, count(DISTINCT o) AS neighbors FROM (SELECT pg_id, dst_uuid AS node_uuid, src_uuid AS o FROM lc UNION ALL SELECT pg_id, src_uuid, dst_uuid FROM lc) GROUP BY ALL
), nf AS (SELECT g.*, coalesce(ld.in_degree, 0) AS in_degree, coalesce(lo.out_degree, 0) AS out_degree, coalesce(neighbors, 0) AS unique_neighbor_count, coalesce(nt.entity_type, 'UNKNOWN') AS entity_type FROM (
    SELECT pg_id, any_value(logical_day) AS logical_day, node_uuid, greatest(1, any_value(end_ns) - any_value(start_ns)) AS len, count_if(role = 'subject') AS subject_count, count_if(role = 'predicate') AS predicate_count, count_if(role = 'predicate2') AS predicate2_count,
      count_if(event_type = 'EVENT_EXECUTE') AS c0, count_if(event_type = 'EVENT_READ') AS c1, count_if(event_type = 'EVENT_SENDTO') AS c2, count_if(event_type = 'EVENT_WRITE') AS c3, count_if(event_type IN ('EVENT_EXECUTE', 'EVENT_READ', 'EVENT_SENDTO', 'EVENT_WRITE')) AS event_count,
      max(timestamp_ns) - min(timestamp_ns) AS span, CASE WHEN count(*) > 1 THEN (max(timestamp_ns) - min(timestamp_ns)) / (count(*) - 1) ELSE 0.0 END AS mean_gap, coalesce(max(gap), 0) AS max_gap
    FROM (SELECT *, timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY pg_id, node_uuid ORDER BY timestamp_ns) AS gap FROM lt) GROUP BY pg_id, node_uuid) g LEFT JOIN nt USING (node_uuid) LEFT JOIN ld USING (pg_id, node_uuid) LEFT JOIN lo USING (pg_id, node_uuid) LEFT JOIN ln USING (pg_id, node_uuid))"""
TYPE_ID = "CASE entity_type WHEN 'SUBJECT_PROCESS' THEN 0 WHEN 'FILE_OBJECT_FILE' THEN 1 WHEN 'FILE_OBJECT_DIR' THEN 2 WHEN 'FILE_OBJECT_UNIX_SOCKET' THEN 3 WHEN 'NET_FLOW' THEN 4 WHEN 'SRC_SINK' THEN 5 WHEN 'UNNAMED_PIPE' THEN 6 WHEN 'PRINCIPAL' THEN 7 WHEN 'HOST' THEN 8 ELSE 9 END"
NAMES = ", ".join(f"'{n}'" for n in features.target_names())
TARGETS = f"""tl AS (SELECT pg_id, node_uuid, logical_day, unnest(range(14)) AS i, unnest([c0 / greatest(1, event_count), c1 / greatest(1, event_count), c2 / greatest(1, event_count), c3 / greatest(1, event_count), subject_count / (subject_count + predicate_count + predicate2_count), predicate_count / (subject_count + predicate_count + predicate2_count), predicate2_count / (subject_count + predicate_count + predicate2_count),
  span / len, mean_gap / len, max_gap / len, ln(1 + event_count), ln(1 + in_degree), ln(1 + out_degree), ln(1 + unique_neighbor_count)]) AS x FROM nf)"""
ROBUST = f"""{LEAVES}, {LEAF_ROWS}, {TARGETS}, cal AS (SELECT * FROM tl WHERE logical_day BETWEEN 13 AND 18), cen AS (SELECT i, median(x) AS center FROM cal GROUP BY i), sca AS (SELECT i, any_value(center) AS center, 1.4826 * median(abs(x - center)) AS scale FROM cal JOIN cen USING (i) GROUP BY i),
par AS (SELECT i, center, CASE WHEN scale > 1e-6 THEN scale ELSE coalesce((SELECT median(scale) FROM sca WHERE scale > 1e-6), 1.0) END AS scale FROM sca), z AS (SELECT pg_id, node_uuid, i, abs(x - center) / scale AS z FROM tl JOIN par USING (i) WHERE logical_day > 18)"""


def leaves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events with their interval, the intervals, and touches and edges of those events."""
    ev = events(spark, sf)
    pgs = graph.bisect(ev)
    pgs = settled(pgs)  # a row an interval, which five parts of a plan read
    placed = graph.assign(ev, pgs)
    return placed, pgs, graph.touches(placed, *features.SCOPE), graph.edges(placed)


def leaf_features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Node features and compressed edges of all intervals."""
    _, _, touch, edges = leaves(spark, sf)
    day = touch.groupBy("pg_id").agg(F.min("logical_day").alias("logical_day"))
    nodes = features.node_features(touch, edges, graph.node_types(node_definitions(spark, sf))).join(day, "pg_id")
    return nodes, graph.compress(edges, "pg_id")


@query(f"""{LEAVES}, {LEAF_ROWS} SELECT pg_id, node_uuid, CAST({TYPE_ID} AS INT) AS entity_type_id, event_count, subject_count, predicate_count, predicate2_count, round(c0 / greatest(1, event_count), 9) AS d0, round(c1 / greatest(1, event_count), 9) AS d1, round(c2 / greatest(1, event_count), 9) AS d2, round(c3 / greatest(1, event_count), 9) AS d3,
span AS activity_span_ns, max_gap AS max_gap_ns, round(span / len, 9) AS span_ratio, round(mean_gap / len, 9) AS mean_gap_ratio, round(max_gap / len, 9) AS max_gap_ratio, in_degree, out_degree, unique_neighbor_count FROM nf""")
def node_features(spark, sf):
    n, _ = leaf_features(spark, sf)
    ratios = [F.round(c, 9).alias(c) for c in ("span_ratio", "mean_gap_ratio", "max_gap_ratio")]
    return n.select("pg_id", "node_uuid", "entity_type_id", "event_count", "subject_count", "predicate_count", "predicate2_count", *(F.round(F.col("action_distribution")[i], 9).alias(f"d{i}") for i in range(4)), "activity_span_ns", "max_gap_ns", *ratios, "in_degree", "out_degree", "unique_neighbor_count")


@query(f"""{LEAVES}, {LEAF_ROWS} SELECT pg_id, start_ns, end_ns, CAST(depth AS INT) AS split_depth, start_ns % {DAY_NS} <> 0 AS left_split_boundary, end_ns % {DAY_NS} <> 0 AS right_split_boundary, coalesce(ev, 0) AS event_count, coalesce(nodes, 0) AS node_count, coalesce(comp, 0) AS compressed_edge_count, coalesce(unknown, 0) AS unknown_type_count FROM leaf
LEFT JOIN (SELECT leaf.pg_id, count(*) AS ev FROM e JOIN leaf ON timestamp_ns >= start_ns AND timestamp_ns < end_ns GROUP BY 1) USING (pg_id) LEFT JOIN (SELECT pg_id, count(*) AS nodes, count_if(entity_type = 'UNKNOWN') AS unknown FROM nf GROUP BY 1) USING (pg_id) LEFT JOIN (SELECT pg_id, count(*) AS comp FROM lc GROUP BY 1) USING (pg_id)""")
def pg_records(spark, sf):
    """Intervals with their candidate's boundaries and all counts."""
    placed, pgs, touch, edges = leaves(spark, sf)
    nodes = features.typed(touch.select("pg_id", "node_uuid").distinct(), graph.node_types(node_definitions(spark, sf)))
    out = pgs.select("pg_id", "start_ns", "end_ns", F.col("depth").alias("split_depth"), (F.col("start_ns") % DAY_NS != 0).alias("left_split_boundary"), (F.col("end_ns") % DAY_NS != 0).alias("right_split_boundary"))
    n = F.count(F.lit(1))
    for part in (placed.groupBy("pg_id").agg(n.alias("event_count")), nodes.groupBy("pg_id").agg(n.alias("node_count"), F.count_if(F.col("entity_type") == "UNKNOWN").alias("unknown_type_count")), graph.compress(edges, "pg_id").groupBy("pg_id").agg(n.alias("compressed_edge_count"))):
        out = out.join(part, "pg_id", "left")
    return out.na.fill(0)


@query(f"""{LEAVES}, {LEAF_ROWS}, ends AS (SELECT pg_id, dst_uuid AS node_uuid, src_uuid AS other, 'incoming' AS way, event_type, ln(1 + event_count) AS w FROM lc UNION ALL SELECT pg_id, src_uuid, dst_uuid, 'outgoing', event_type, ln(1 + event_count) FROM lc), b AS (SELECT ends.*, n.entity_type FROM ends JOIN nf n ON n.pg_id = ends.pg_id AND n.node_uuid = ends.other WHERE event_type IN ('EVENT_EXECUTE', 'EVENT_READ', 'EVENT_SENDTO', 'EVENT_WRITE')),
g AS (SELECT pg_id, node_uuid, way || '_relation:' || event_type AS name, sum(w) / any_value(t) AS v FROM (SELECT *, sum(w) OVER (PARTITION BY pg_id, node_uuid, way) AS t FROM b) GROUP BY ALL UNION ALL SELECT pg_id, node_uuid, way || '_neighbor_type:' || entity_type, sum(w) / any_value(t) FROM (SELECT *, sum(w) OVER (PARTITION BY pg_id, node_uuid, way) AS t FROM b) GROUP BY ALL
UNION ALL SELECT pg_id, node_uuid, 'self_type:' || entity_type, 1.0 FROM nf UNION ALL SELECT pg_id, node_uuid, 'context:log_in_degree', ln(1 + in_degree) FROM nf UNION ALL SELECT pg_id, node_uuid, 'context:log_out_degree', ln(1 + out_degree) FROM nf), {TARGETS}
SELECT pg_id, node_uuid, name, round(v, 6) AS value FROM g WHERE v > 0 UNION ALL SELECT pg_id, node_uuid, [{NAMES}][i + 1], round(x, 6) FROM tl WHERE x > 0""")
def signatures(spark, sf):
    """Context and target of every node, one row a coordinate over zero."""
    s = features.signatures(*leaf_features(spark, sf))
    names = F.array(*map(F.lit, features.context_names() + features.target_names()))
    return s.select("pg_id", "node_uuid", F.posexplode(F.concat("context", "target")).alias("i", "v")).where("v > 0").select("pg_id", "node_uuid", F.element_at(names, F.col("i") + 1).alias("name"), F.round("v", 6).alias("value"))


def _robust(spark: SparkSession, sf: str) -> DataFrame:
    s = settled(features.signatures(*leaf_features(spark, sf)).select("pg_id", "node_uuid", "logical_day", F.col("target").alias("residual")))
    return features.robust_scores(s.where("logical_day > 18"), features.residual_calibration(s.where("logical_day between 13 and 18")))


@query(f"{ROBUST} SELECT pg_id, node_uuid, round(avg(z), 5) AS score FROM z GROUP BY ALL")
def robust_scores(spark, sf):
    return _robust(spark, sf).select("pg_id", "node_uuid", F.round("score", 5).alias("score"))


@query(f"{ROBUST} SELECT pg_id, node_uuid, rank, [{NAMES}][i + 1] AS feature, round(z, 5) AS standardized_deviation FROM (SELECT *, row_number() OVER (PARTITION BY pg_id, node_uuid ORDER BY round(z, 5) DESC, i) AS rank FROM z) WHERE rank <= 5")
def top_deviations(spark, sf):
    rounded = _robust(spark, sf).withColumn("standardized", F.transform("standardized", lambda x: F.round(x, 5)))
    top = scoring.top_deviations(rounded, features.target_names())
    return top.select("pg_id", "node_uuid", F.posexplode("top").alias("at", "t")).select("pg_id", "node_uuid", (F.col("at") + 1).cast("long").alias("rank"), "t.feature", "t.standardized_deviation")


@query()
def masked_scores(spark, sf):
    """Residuals of the masked predictor, scored by shrinkage models of their type and calibrated on other days."""
    s = settled(features.signatures(*leaf_features(spark, sf)).select("pg_id", "node_uuid", "logical_day", "entity_type_id", "context", "target"))
    model = predictor.fit_predictor(s.where("logical_day <= 8"), features.context_names(), features.target_names(), rows=20_000)
    r = settled(predictor.residuals(s, model).drop("context", "target"))
    models = residual.shrinkage_models(r.where("logical_day between 9 and 12"), n_min=128, pooled=True)
    out = residual.calibrated(r.where("logical_day between 13 and 18"), r.where("logical_day > 18"), models)
    return out.select("pg_id", "node_uuid", F.round("score", 4).alias("score"), F.round("q", 6).alias("q"))


@query(f"""{LEAVES}, {LEAF_ROWS}, seeds AS (SELECT pg_id, node_uuid FROM (SELECT *, row_number() OVER (PARTITION BY pg_id ORDER BY event_count DESC, node_uuid) AS o FROM nf) WHERE o = 1), c AS (SELECT s.pg_id, s.node_uuid AS seed_uuid, 0 AS way, lc.* EXCLUDE (pg_id) FROM seeds s JOIN lc ON lc.pg_id = s.pg_id AND src_uuid = s.node_uuid UNION ALL SELECT s.pg_id, s.node_uuid, 1, lc.* EXCLUDE (pg_id) FROM seeds s JOIN lc ON lc.pg_id = s.pg_id AND dst_uuid = s.node_uuid)
SELECT pg_id, seed_uuid, position, src_uuid, dst_uuid, event_type, CAST(predicate_index AS INT) AS predicate_index, CASE way WHEN 0 THEN 'forward' ELSE 'backward' END AS traversal_direction FROM (SELECT *, row_number() OVER (PARTITION BY pg_id, seed_uuid ORDER BY way, f[1], src_uuid, dst_uuid, event_type, predicate_index) AS position FROM c) WHERE position <= 40""")
def one_hop_search(spark, sf):
    """The first 40 edges around the busiest node of each interval, one hop out."""
    n, c = leaf_features(spark, sf)
    seeds = n.groupBy("pg_id").agg(F.min(F.struct((-F.col("event_count")).alias("k"), "node_uuid")).alias("s")).select("pg_id", "s.node_uuid")
    return traversal.bounded_search(c, seeds, hops=1).select("pg_id", "seed_uuid", F.col("position").cast("long").alias("position"), "src_uuid", "dst_uuid", "event_type", "predicate_index", "traversal_direction")


#: Seeds, numbered edges with both ways of looking at them, and the breadth-first edges of two hops.
AROUND = f"""{LEAVES}, {LEAF_ROWS}, seeds AS (SELECT pg_id, node_uuid AS seed_uuid FROM (SELECT *, row_number() OVER (PARTITION BY pg_id ORDER BY event_count DESC, node_uuid) AS o FROM nf) WHERE o = 1
), le1 AS (SELECT pg_id, src_uuid, dst_uuid, event_type, predicate_index, f[1] AS first_timestamp_ns, first_event_uuid, row_number() OVER (PARTITION BY pg_id ORDER BY f[1], src_uuid, dst_uuid, event_type, predicate_index) AS i FROM lc
), side AS (SELECT pg_id, i, 0 AS way, src_uuid AS node, dst_uuid AS far FROM le1 UNION ALL SELECT pg_id, i, 1, dst_uuid, src_uuid FROM le1
), h1 AS (SELECT pg_id, seed_uuid, way, i, far FROM seeds JOIN side USING (pg_id) WHERE node = seed_uuid
), n1 AS (SELECT pg_id, seed_uuid, way, far AS node, min(i) AS found FROM h1 GROUP BY ALL
), bfs AS (SELECT pg_id, seed_uuid, way, i, hop, row_number() OVER (PARTITION BY pg_id ORDER BY hop, way, found, i) AS position FROM (
    SELECT pg_id, seed_uuid, way, i, 1 AS hop, 0 AS found FROM h1 UNION ALL SELECT n1.pg_id, n1.seed_uuid, n1.way, s.i, 2, found FROM n1 JOIN side s ON s.pg_id = n1.pg_id AND s.way = n1.way AND s.node = n1.node) QUALIFY position <= 40)"""
EDGE = "src_uuid, dst_uuid, event_type, CAST(predicate_index AS INT) AS predicate_index, CAST(first_timestamp_ns AS BIGINT) AS first_timestamp_ns, first_event_uuid"
WAY = "CASE way WHEN 0 THEN 'forward' ELSE 'backward' END AS traversal_direction, CAST(hop AS INT) AS hop"
#: One edge a neighbour (those with a write before the others), then the other edges, ways in turn; then new ones of the first 40 breadth-first edges.
COVER = f"""{AROUND}, r1 AS (SELECT h1.*, event_type = 'EVENT_WRITE' AS liked, span / len AS q, bool_or(event_type = 'EVENT_WRITE') OVER nb AS any_liked, row_number() OVER (PARTITION BY h1.pg_id, way, far ORDER BY event_type <> 'EVENT_WRITE', i) AS place
    FROM h1 JOIN le1 USING (pg_id, i) JOIN nf ON nf.pg_id = h1.pg_id AND nf.node_uuid = far WINDOW nb AS (PARTITION BY h1.pg_id, way, far)
), tier AS (SELECT *, CASE WHEN place > 1 THEN 2 WHEN any_liked THEN 0 ELSE 1 END AS t FROM r1
), near AS (SELECT *, row_number() OVER (PARTITION BY pg_id, t, way ORDER BY q DESC, i) AS p FROM tier
), marked AS (SELECT x.*, (src_uuid, dst_uuid, event_type, first_timestamp_ns) AS mark FROM (
    SELECT pg_id, seed_uuid, way, i, 1 AS hop, 0 AS stage, row_number() OVER (PARTITION BY pg_id ORDER BY t, p, way) AS o FROM near UNION ALL SELECT pg_id, seed_uuid, way, i, hop, 1, position FROM bfs) x JOIN le1 USING (pg_id, i)
), fill AS (SELECT * FROM marked WHERE stage = 0 UNION ALL (SELECT * FROM marked m WHERE stage = 1 AND NOT EXISTS (SELECT 1 FROM marked u WHERE u.stage = 0 AND u.pg_id = m.pg_id AND u.mark = m.mark) QUALIFY row_number() OVER (PARTITION BY pg_id, mark ORDER BY o) = 1)
), out AS (SELECT *, row_number() OVER (PARTITION BY pg_id ORDER BY stage, o) AS position FROM fill QUALIFY position <= 40)"""
#: The seed's edges, then those of its neighbours by id, incoming and outgoing in turn, writes and high scores first.
CONTEXT = f"""{AROUND}, rk AS (SELECT side.pg_id, side.i, node, 1 - way AS turn, row_number() OVER (PARTITION BY side.pg_id, node, way ORDER BY event_type <> 'EVENT_WRITE', span / len DESC, first_timestamp_ns, first_event_uuid, predicate_index, src_uuid, dst_uuid) AS p
    FROM side JOIN le1 USING (pg_id, i) JOIN nf ON nf.pg_id = side.pg_id AND nf.node_uuid = far
), own AS (SELECT pg_id, seed_uuid, i, row_number() OVER (PARTITION BY pg_id ORDER BY p, turn) AS o FROM rk JOIN seeds USING (pg_id) WHERE node = seed_uuid QUALIFY o <= 40
), around AS (SELECT DISTINCT pg_id, seed_uuid, unnest([src_uuid, dst_uuid]) AS node FROM own JOIN le1 USING (pg_id, i)
), every AS (SELECT pg_id, seed_uuid, i, '' AS node, o AS p, 0 AS turn FROM own UNION ALL SELECT pg_id, seed_uuid, i, node, p, turn FROM around JOIN rk USING (pg_id, node) WHERE node <> seed_uuid
), once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY pg_id, i ORDER BY node, p, turn) = 1
), out AS (SELECT *, row_number() OVER (PARTITION BY pg_id ORDER BY node, p, turn) AS position FROM once QUALIFY position <= 40)"""


def _context(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compressed edges, seeds and scores of all intervals: the node with the most events is the seed, its share of events the score."""
    n, c = leaf_features(spark, sf)
    seeds = n.groupBy("pg_id").agg(F.min(F.struct((-F.col("event_count")).alias("k"), "node_uuid")).alias("s")).select("pg_id", "s.node_uuid", F.array(F.lit("EVENT_WRITE")).alias("event_types"))
    return c, seeds, n.select("pg_id", "node_uuid", "span_ratio").withColumnRenamed("span_ratio", "q")


@query(f"{AROUND} SELECT pg_id, seed_uuid, CAST(position AS INT) AS position, {EDGE}, {WAY} FROM bfs JOIN le1 USING (pg_id, i)")
def bounded_search(spark, sf):
    return traversal.bounded_search(*_context(spark, sf)[:2])


@query(f"{COVER} SELECT o.pg_id, seed_uuid, CAST(position AS INT) AS position, le1.src_uuid, le1.dst_uuid, le1.event_type, CAST(le1.predicate_index AS INT) AS predicate_index, CAST(le1.first_timestamp_ns AS BIGINT) AS first_timestamp_ns, le1.first_event_uuid, {WAY} FROM out o JOIN le1 ON le1.pg_id = o.pg_id AND le1.i = o.i")
def neighbor_cover(spark, sf):
    return traversal.neighbor_cover(*_context(spark, sf))


@query(f"{CONTEXT} SELECT pg_id, seed_uuid, CAST(position AS INT) AS position, {EDGE} FROM out JOIN le1 USING (pg_id, i)")
def bounded_context(spark, sf):
    return traversal.bounded_context(*_context(spark, sf))


@query(f"""{WITH}, r AS (SELECT event_uuid, unnest([host_uuid, subject_uuid, predicate_uuid, predicate2_uuid]) AS ref, unnest(range(4)) AS place FROM e) SELECT event_uuid, row_number() OVER (PARTITION BY event_uuid ORDER BY place) - 1 AS position, ref AS reference FROM r WHERE ref IS NOT NULL""")
def event_references(spark, sf):
    """Ids that an event names, in order: host, subject, objects."""
    some = F.filter(F.array("host_uuid", "subject_uuid", "predicate_uuid", "predicate2_uuid"), lambda x: x.isNotNull())
    return events(spark, sf).select("event_uuid", F.posexplode(some).alias("position", "reference")).withColumn("position", F.col("position").cast("long"))


@query(f"""{LEAVES}, {LEAF_ROWS}, c AS (SELECT lc.logical_day, dst_uuid AS node_uuid, event_type, coalesce(entity_type, 'UNKNOWN') AS other_type, 'incoming' AS way, event_count FROM lc LEFT JOIN nt ON nt.node_uuid = src_uuid UNION ALL SELECT lc.logical_day, src_uuid, event_type, coalesce(entity_type, 'UNKNOWN'), 'outgoing', event_count FROM lc LEFT JOIN nt ON nt.node_uuid = dst_uuid)
SELECT logical_day, node_uuid, way, event_type, other_type, round(sum(ln(1 + event_count)), 5) AS context FROM c GROUP BY ALL""")
def relation_context(spark, sf):
    _, _, _, edges = leaves(spark, sf)
    c = graph.compress(edges, "pg_id", "logical_day")
    t = graph.node_types(node_definitions(spark, sf))
    ends = F.inline(F.array(F.struct(F.col("dst_uuid").alias("end"), F.col("src_uuid").alias("node_uuid"), F.lit("incoming").alias("way")), F.struct(F.col("src_uuid").alias("end"), F.col("dst_uuid").alias("node_uuid"), F.lit("outgoing").alias("way"))))
    both = features.typed(c.select("logical_day", "event_type", "event_count", ends), t)
    return both.groupBy("logical_day", F.col("end").alias("node_uuid"), "way", "event_type", F.col("entity_type").alias("other_type")).agg(F.round(F.sum(F.log1p("event_count")), 5).alias("context"))


LABELS = "lab AS (SELECT DISTINCT md5('u' || doc_id) AS node_uuid FROM labels WHERE toxic = 1)"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").where("toxic = 1").select(F.md5(F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("node_uuid"))


def _variants(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of two variants over days as intervals: as they are, and of processes alone."""
    s = _scores(spark, sf).withColumns({"start_ns": F.col("logical_day").cast("long"), "end_ns": F.col("logical_day").cast("long") + 1, "is_candidate": F.col("score") >= 2})
    return s.withColumn("variant", F.explode(F.when(F.col("entity_type") == "SUBJECT_PROCESS", F.array(F.lit("all"), F.lit("process"))).otherwise(F.array(F.lit("all")))))


VARIANTS = f"{ALL_SCORES}, {LABELS}, vs AS (SELECT 'all' AS variant, * FROM scores UNION ALL SELECT 'process', * FROM scores WHERE entity_type = 'SUBJECT_PROCESS'), w AS (SELECT * FROM vs WHERE logical_day + 1 > 10 AND logical_day < 25), n AS (SELECT variant, node_uuid, max(score) AS score, bool_or(score >= 2) AS candidate, count(*) AS records FROM w GROUP BY ALL), j AS (SELECT n.*, lab.node_uuid IS NOT NULL AS label, row_number() OVER (PARTITION BY variant ORDER BY score DESC, n.node_uuid) AS rank, count(*) OVER (PARTITION BY variant) AS size FROM n LEFT JOIN lab ON lab.node_uuid = n.node_uuid)"


@query(f"""{VARIANTS}, l AS (SELECT count(*) AS labels FROM lab), g AS (SELECT variant, count(*) AS nodes, CAST(sum(records) AS BIGINT) AS records, count_if(candidate) AS candidates, any_value(labels) AS labels, count_if(candidate AND label) AS covered, count_if(candidate AND NOT label) AS unmatched, count_if(label AND rank <= 10) AS h10, count_if(label AND rank <= 50) AS h50, count_if(label AND rank <= 100) AS h100 FROM j, l GROUP BY variant),
p AS (SELECT *, coalesce(covered / nullif(candidates, 0), 0.0) AS pr, coalesce(covered / nullif(labels, 0), 0.0) AS re FROM g) SELECT variant, nodes, records, candidates, labels, covered, unmatched, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1, round(coalesce(h10 / nullif(labels, 0), 0.0), 6) AS recall_at_10, round(coalesce(h50 / nullif(labels, 0), 0.0), 6) AS recall_at_50, round(coalesce(h100 / nullif(labels, 0), 0.0), 6) AS recall_at_100 FROM p""")
def detector_eval(spark, sf):
    return scoring.evaluate(_variants(spark, sf), _labels(spark, sf), window=(10, 25))


@query(f"{VARIANTS} SELECT variant, node_uuid, rank, round(1 - (rank - 1) / size, 6) AS percentile FROM j WHERE label")
def label_ranks(spark, sf):
    s = _variants(spark, sf).where("end_ns > 10 and start_ns < 25")
    return scoring.label_ranks(s, _labels(spark, sf)).withColumn("percentile", F.round("percentile", 6))


@query(f"""{ALL_SCORES}, {PERCENTILE}, b AS (SELECT *, least(16, CAST(ceil(CAST(0.05 AS DOUBLE) * count(*) OVER (PARTITION BY logical_day)) AS BIGINT)) AS budget, substr(node_uuid, 3) AS tie FROM pct), r AS (SELECT *, row_number() OVER (PARTITION BY logical_day ORDER BY q DESC, tie, node_uuid) AS rank FROM b WHERE q >= 0.9)
SELECT CAST(logical_day AS VARCHAR) AS pg_id, node_uuid AS entity_id, round(q, 6) AS percentile, CASE WHEN q >= 0.97 THEN 'anchor' ELSE 'context_carrier' END AS role, rank AS rank_within_pg, budget AS pg_budget FROM r WHERE rank <= budget""")
def select_evidence(spark, sf):
    q = _percentiles(spark, sf).select(F.col("logical_day").cast("string").alias("pg_id"), F.col("node_uuid").alias("entity_id"), F.col("q").alias("percentile"), F.expr("substr(node_uuid, 3)").alias("stable_tie_id"))
    return scoring.select_evidence(q, 0.9, 0.97, 16, 0.05).withColumn("percentile", F.round("percentile", 6))


@query("""WITH t AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(source), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b, list_distinct(regexp_extract_all(lower(lang), '[a-z0-9]+')) AS c FROM documents), s AS (SELECT id, 4 * len(list_intersect(a, ['the', 'thing', 'src3', 'en'])) + 2 * len(list_intersect(c, ['the', 'thing', 'src3', 'en'])) + len(list_intersect(b, ['the', 'thing', 'src3', 'en'])) AS score FROM t)
SELECT id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 5""")
def technique_search(spark, sf):
    return term_search(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("body"), F.array("lang").alias("tactics")), "The thing, src3 en")


@query("SELECT sha256(string_agg(event_type, chr(10) ORDER BY event_type)) AS fingerprint, count(*) AS n FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)")
def vocabulary_fingerprint(spark, sf):
    names = sorted(r[0] for r in table(spark, sf, "events").where("event_type is not null").select("event_type").distinct().collect())  # a vocabulary
    return spark.createDataFrame([(event_type_fingerprint(names), len(names))], "fingerprint string, n long")
