"""Community graph: direct relations, continuations, witnesses, roll-ups, bridges and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINEAGE = ("EVENT_FORK", "EVENT_EXECUTE")
ORDER = ("timestamp_ns", "evidence_id")


def memberships(nodes: DataFrame) -> DataFrame:
    """A deterministic partition: one community per interval and entity type."""
    return nodes.withColumn("community_id", F.format_string("d%02d:%s:c%05d", F.col("logical_day"), F.col("pg_id"), F.col("entity_type_id")))


def witnesses(compressed: DataFrame) -> DataFrame:
    """Compressed edges as evidence: evidence_id and timestamp_ns (of the first event) beside all that an edge has."""
    return compressed.withColumn("evidence_id", F.concat(F.lit("event:"), F.col("first_event_uuid"), F.lit(":p"), F.col("predicate_index"))).withColumnRenamed("first_timestamp_ns", "timestamp_ns")


def witness_records(witness: DataFrame, evidence: DataFrame) -> DataFrame:
    """indexed() rows with the whole record of their evidence: ends, event, type, predicate, counts and place in the log. evidence: rows of witnesses()."""
    e = evidence.select("evidence_id", "pg_id", "src_uuid", "dst_uuid", F.col("first_event_uuid").alias("event_uuid"), "event_type", "predicate_index", "event_count", F.col("first_raw_shard").alias("raw_shard"), F.col("first_raw_line").alias("raw_line"), F.col("first_raw_offset").alias("raw_offset"))
    return witness.join(e, "evidence_id", "left")


def edge_id(kind, src, dst):
    return F.concat(F.lit("fmg-"), F.substring(F.sha2(F.concat(kind, F.lit("\0"), src, F.lit("\0"), dst), 256), 1, 24))


def direct(witness: DataFrame, member: DataFrame) -> DataFrame:
    """Witness rows of relations between communities of one interval."""
    m = member.select("pg_id", "node_uuid", "community_id")
    src = m.select("pg_id", F.col("node_uuid").alias("src_uuid"), F.col("community_id").alias("src_community_id"))
    dst = m.select("pg_id", F.col("node_uuid").alias("dst_uuid"), F.col("community_id").alias("dst_community_id"))
    out = witness.join(src, ["pg_id", "src_uuid"]).join(dst, ["pg_id", "dst_uuid"]).where("src_community_id <> dst_community_id")
    return out.withColumn("edge_type", F.when(F.col("event_type").isin(*LINEAGE), "entity_lineage").otherwise("provenance_reachability")).select("src_community_id", "dst_community_id", "edge_type", "timestamp_ns", "evidence_id", F.lit("event").alias("side"), F.lit(None).cast("string").alias("entity_uuid"))


def occurrences(witness: DataFrame) -> DataFrame:
    """First and last witness of each node in each interval (last by the first time of its edges)."""
    ends = witness.select("pg_id", F.col("src_uuid").alias("node_uuid"), *ORDER).unionByName(witness.select("pg_id", F.col("dst_uuid").alias("node_uuid"), *ORDER))
    key = F.struct(*ORDER)
    out = ends.groupBy("pg_id", "node_uuid").agg(F.min(key).alias("f"), F.max(key).alias("l"))
    return out.select("pg_id", "node_uuid", F.col("f.timestamp_ns").alias("first_ns"), F.col("f.evidence_id").alias("first_evidence"), F.col("l.timestamp_ns").alias("last_ns"), F.col("l.evidence_id").alias("last_evidence"))


def adjacent(pgs: DataFrame, candidate_ns: int | None = None) -> DataFrame:
    """pg_id, right_pg, edge_type of intervals that follow each other without a gap.

    Where both come from one candidate, cut apart inside it, they are a split continuation: told by the columns candidate_start_ns,
    candidate_end_ns, left_split_boundary and right_split_boundary, or, for aligned candidates of candidate_ns, by the place of both starts.
    """
    order = Window.orderBy("start_ns", "end_ns", "pg_id")  # one row an interval
    keep = ["pg_id", "start_ns"] if candidate_ns else ["pg_id", "start_ns", "candidate_start_ns", "candidate_end_ns", "left_split_boundary"]
    nxt = F.lead(F.struct(*keep)).over(order)
    both = pgs.withColumn("nxt", nxt).where(F.col("end_ns") == F.col("nxt.start_ns"))
    if candidate_ns:
        split = F.expr(f"start_ns div {candidate_ns} = nxt.start_ns div {candidate_ns}")
    else:
        split = F.col("right_split_boundary") & F.col("nxt.left_split_boundary") & (F.col("candidate_start_ns") == F.col("nxt.candidate_start_ns")) & (F.col("candidate_end_ns") == F.col("nxt.candidate_end_ns"))
    return both.select("pg_id", F.col("nxt.pg_id").alias("right_pg"), F.when(split, "split_continuation").otherwise("entity_continuation").alias("edge_type"))


def stitched(pairs: DataFrame, member: DataFrame, occurrence: DataFrame) -> DataFrame:
    """Witness rows (left and right) of the entities that both intervals of a pair share, with pg_id and right_pg; the last time left is not after the first time right."""
    m = member.select("pg_id", "node_uuid", "community_id").join(occurrence, ["pg_id", "node_uuid"])
    left = m.select("pg_id", "node_uuid", F.col("community_id").alias("src_community_id"), "last_ns", "last_evidence")
    right = m.select(F.col("pg_id").alias("right_pg"), "node_uuid", F.col("community_id").alias("dst_community_id"), "first_ns", "first_evidence")
    both = pairs.join(left, "pg_id").join(right, ["right_pg", "node_uuid"]).where("last_ns <= first_ns")
    sides = F.array(F.struct(F.col("last_ns").alias("timestamp_ns"), F.col("last_evidence").alias("evidence_id"), F.lit("left").alias("side")), F.struct(F.col("first_ns").alias("timestamp_ns"), F.col("first_evidence").alias("evidence_id"), F.lit("right").alias("side")))
    return both.select("src_community_id", "dst_community_id", "edge_type", F.inline(sides), F.col("node_uuid").alias("entity_uuid"), "pg_id", "right_pg")


def continuations(pgs: DataFrame, member: DataFrame, occurrence: DataFrame, candidate_ns: int | None = None) -> DataFrame:
    """Witness rows (left and right) between adjacent intervals that share an entity."""
    return stitched(adjacent(pgs, candidate_ns), member, occurrence).drop("pg_id", "right_pg")


def relations(witness: DataFrame) -> DataFrame:
    """One row a relation, with counts and times of its witnesses."""
    g = witness.groupBy("src_community_id", "dst_community_id", "edge_type").agg(F.count(F.lit(1)).alias("witness_count"), F.countDistinct("entity_uuid").alias("witness_entity_count"), F.min("timestamp_ns").alias("first_witness_ns"), F.max("timestamp_ns").alias("last_witness_ns"))
    return g.select(edge_id(F.col("edge_type"), F.col("src_community_id"), F.col("dst_community_id")).alias("fmg_edge_id"), "*", F.when(F.col("edge_type").endswith("continuation"), "identity_continuity").otherwise("causal_event").alias("evidence_semantics"), F.when(F.col("edge_type").endswith("continuation"), "continues").otherwise("before").alias("time_relation"))


def indexed(witness: DataFrame) -> DataFrame:
    """Witness rows numbered from 0 inside their relation by time, evidence and side."""
    w = Window.partitionBy("src_community_id", "dst_community_id", "edge_type").orderBy("timestamp_ns", "evidence_id", "side", "entity_uuid")
    return witness.select(edge_id(F.col("edge_type"), F.col("src_community_id"), F.col("dst_community_id")).alias("fmg_edge_id"), (F.row_number().over(w) - 1).cast("long").alias("witness_index"), "side", "evidence_id", "entity_uuid", "timestamp_ns")


def bridges(relation: DataFrame, communities: DataFrame | None = None, excluded: DataFrame | None = None, witness: DataFrame | None = None) -> DataFrame:
    """All two-step paths between communities without a direct relation, ranked for each pair of ends: causal steps first.

    communities (community_id, start_ns, end_ns): only middles that overlap the time from the first start to the last end
    of both ends. excluded (left_id, right_id, middle_id): middles not to use between two ends; they take no rank.
    witness: rows as of relations(); adds witness_ids, the sorted evidence ids of both steps.
    """
    r = relation.select("src_community_id", "dst_community_id", "fmg_edge_id", (F.col("evidence_semantics") == "causal_event").cast("int").alias("c"))
    one = r.select(F.col("src_community_id").alias("left_id"), F.col("dst_community_id").alias("middle_id"), F.col("fmg_edge_id").alias("first_edge"), F.col("c").alias("c1"))
    two = r.select(F.col("src_community_id").alias("middle_id"), F.col("dst_community_id").alias("right_id"), F.col("fmg_edge_id").alias("second_edge"), F.col("c").alias("c2"))
    ends = r.select(F.col("src_community_id").alias("left_id"), F.col("dst_community_id").alias("right_id")).distinct()
    path = one.join(two, "middle_id").where("left_id <> right_id").join(ends, ["left_id", "right_id"], "left_anti").withColumn("causal_count", F.col("c1") + F.col("c2"))
    if excluded is not None:
        path = path.join(excluded.select("left_id", "right_id", "middle_id").distinct(), ["left_id", "right_id", "middle_id"], "left_anti")
    if communities is not None:
        for side in ("left", "middle", "right"):
            path = path.join(communities.select(F.col("community_id").alias(f"{side}_id"), F.col("start_ns").alias(f"{side}_start"), F.col("end_ns").alias(f"{side}_end")), f"{side}_id")
        path = path.where((F.col("middle_end") > F.least("left_start", "right_start")) & (F.col("middle_start") < F.greatest("left_end", "right_end")))
    w = Window.partitionBy("left_id", "right_id").orderBy(F.desc("causal_count"), "middle_id", "first_edge", "second_edge")
    kind = F.when(F.col("causal_count") == 2, "causal_path").when(F.col("causal_count") == 1, "mixed_path").otherwise("identity_only")
    out = path.select("left_id", "middle_id", "right_id", "first_edge", "second_edge", kind.alias("path_class"), F.row_number().over(w).cast("long").alias("rank"))
    if witness is None:
        return out
    ids = witness.select(edge_id(F.col("edge_type"), F.col("src_community_id"), F.col("dst_community_id")).alias("edge"), "evidence_id").groupBy("edge").agg(F.collect_set("evidence_id").alias("ids"))
    for step in ("first", "second"):
        out = out.join(ids.select(F.col("edge").alias(f"{step}_edge"), F.col("ids").alias(f"{step}_ids")), f"{step}_edge", "left")
    both = F.array_sort(F.array_union(F.coalesce("first_ids", F.array().cast("array<string>")), F.coalesce("second_ids", F.array().cast("array<string>"))))
    return out.select("left_id", "middle_id", "right_id", "first_edge", "second_edge", "path_class", "rank", both.alias("witness_ids"))


def schedule_key() -> list[Column]:
    """Order of communities for inspection: with an anchor first, then more boundary flows, higher scores, earlier start, smaller id."""
    return [F.when(F.col("anchor_count") > 0, 0).otherwise(1), F.desc("boundary_flow_count"), F.desc("max_anchor_score"), F.desc("max_carrier_score"), F.asc("start_ns"), F.asc("community_id")]


def ranked_communities(candidates: DataFrame) -> DataFrame:
    """candidates (community_id, anchor_count, boundary_flow_count, max_anchor_score, max_carrier_score, start_ns) with schedule_rank from 1.

    The order is global, so it is made by a range sort: ranks are those of sorted partitions plus the rows of the partitions before.
    """
    key = schedule_key()
    parts = candidates.orderBy(*key).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    return parts.join(F.broadcast(before), "part").withColumn("schedule_rank", F.col("before") + F.col("at") - F.col("first") + 1).drop("part", "at", "n", "first", "before")


def forward_neighborhood(relation: DataFrame, candidates: DataFrame, limit: int = 3) -> DataFrame:
    """For each community its first outgoing relations to candidates: causal before identity, then by the schedule key of the target and the
    edge's id. The limit counts edges, so parallel ones may leave fewer than `limit` communities."""
    ranked = relation.join(candidates.withColumnRenamed("community_id", "dst_community_id"), "dst_community_id").withColumn("community_id", F.col("dst_community_id"))
    w = Window.partitionBy("src_community_id").orderBy(F.when(F.col("evidence_semantics") == "causal_event", 0).otherwise(1), *schedule_key(), "fmg_edge_id")
    return ranked.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit).select("src_community_id", "dst_community_id", "fmg_edge_id", "rank")


def core_continuations(relation: DataFrame, witness_entities: DataFrame, frontier: DataFrame, core: DataFrame, excluded: DataFrame) -> DataFrame:
    """Identity relations that leave the frontier (community_id) for a community that is not excluded and share a witnessed entity
    (fmg_edge_id, entity_uuid) with the core (entity_uuid); rank by first witness, target and id. All set tests are semi and anti joins."""
    shared = witness_entities.join(core.select("entity_uuid"), "entity_uuid", "left_semi").select("fmg_edge_id").distinct()
    out = relation.where("evidence_semantics = 'identity_continuity'").join(frontier.select(F.col("community_id").alias("src_community_id")), "src_community_id", "left_semi")
    out = out.join(excluded.select(F.col("community_id").alias("dst_community_id")), "dst_community_id", "left_anti").join(shared, "fmg_edge_id", "left_semi")
    w = Window.partitionBy("src_community_id").orderBy("first_witness_ns", "dst_community_id", "fmg_edge_id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).select("src_community_id", "dst_community_id", "fmg_edge_id", "first_witness_ns", "rank")


def backbone_transitions(relation: DataFrame) -> DataFrame:
    """For each pair of communities its one transition: causal before identity, lineage before other types, then the smallest id."""
    best = F.min(F.struct((F.col("evidence_semantics") != "causal_event").alias("i"), (F.col("edge_type") != "entity_lineage").alias("t"), "fmg_edge_id", "edge_type", "evidence_semantics"))
    return relation.groupBy("src_community_id", "dst_community_id").agg(best.alias("b")).select("src_community_id", "dst_community_id", "b.fmg_edge_id", "b.edge_type", "b.evidence_semantics")


def community_evidence(witness: DataFrame, member: DataFrame) -> DataFrame:
    """For each community the first witness (time, then place in the log) of an edge that begins or ends in it."""
    m = member.select("pg_id", "node_uuid", "community_id")
    ends = witness.select("pg_id", F.explode(F.array("src_uuid", "dst_uuid")).alias("node_uuid"), "timestamp_ns", "first_raw_offset", "evidence_id")
    first = F.min(F.struct("timestamp_ns", "first_raw_offset", "evidence_id")).alias("f")
    return ends.join(m, ["pg_id", "node_uuid"]).groupBy("community_id").agg(first).select("community_id", "f.timestamp_ns", "f.evidence_id")


def rolled_up(member: DataFrame, scored: DataFrame, selected: DataFrame) -> DataFrame:
    """Per community: nodes, largest percentile (0 without scores), and selected nodes by role. scored: pg_id, node_uuid, q; selected: pg_id, node_uuid, role."""
    rows = member.select("pg_id", "node_uuid", "community_id").join(scored.select("pg_id", "node_uuid", "q"), ["pg_id", "node_uuid"], "left").join(selected.select("pg_id", "node_uuid", "role"), ["pg_id", "node_uuid"], "left")
    return rows.groupBy("community_id").agg(F.count(F.lit(1)).alias("node_count"), F.coalesce(F.max("q"), F.lit(0.0)).alias("max_percentile"), F.count_if(F.col("role") == "anchor").alias("anchor_count"), F.count_if(F.col("role") == "context_carrier").alias("context_carrier_count"))


def bridge_queries(pairs: DataFrame, communities: DataFrame, relation: DataFrame) -> DataFrame:
    """For gaps (gap_id, left_id, right_id): the time to search, min_start_ns to max_end_ns, or an error: an end that is no community, or a direct relation."""
    ends = pairs
    for side in ("left", "right"):
        ends = ends.join(communities.select(F.col("community_id").alias(f"{side}_id"), F.col("start_ns").alias(f"{side}_start"), F.col("end_ns").alias(f"{side}_end")), f"{side}_id", "left")
    direct = relation.select(F.col("src_community_id").alias("left_id"), F.col("dst_community_id").alias("right_id"), F.lit(True).alias("direct")).distinct()
    error = F.when(F.col("left_start").isNull() | F.col("right_start").isNull(), "unknown_endpoint").when(F.col("direct"), "direct_relation_exists")
    fine = error.isNull()
    out = ends.join(direct, ["left_id", "right_id"], "left")
    return out.select("gap_id", "left_id", "right_id", error.alias("error"), F.when(fine, F.least("left_start", "right_start")).alias("min_start_ns"), F.when(fine, F.greatest("left_end", "right_end")).alias("max_end_ns"))


# Errors of a bridge candidate, in the order of their report.
BRIDGE_ERRORS = ("query_id_mismatch", "left_endpoint_mismatch", "right_endpoint_mismatch", "excluded_intermediate", "unknown_edge", "first_edge_path_mismatch", "second_edge_path_mismatch", "missing_witness")


def bridge_errors(candidates: DataFrame, relation: DataFrame) -> DataFrame:
    """candidate_id and errors (array, in order) of candidates: candidate_id, query_id, asked_id (the query's id), left_id, right_id (the query's ends),
    path (three communities), edges (two ids), excluded (array), witness_ids (array). After an unknown edge nothing further is looked at."""
    r = relation.select(F.col("fmg_edge_id"), F.struct("src_community_id", "dst_community_id").alias("ends"))
    c = candidates
    for i, name in enumerate(("first", "second")):
        c = c.join(r.select(F.col("fmg_edge_id").alias(f"{name}_id"), F.col("ends").alias(name)), F.col("edges")[i] == F.col(f"{name}_id"), "left").drop(f"{name}_id")
    path = F.col("path")
    unknown = F.col("first").isNull() | F.col("second").isNull()
    off = lambda name, i: ~((F.col(f"{name}.src_community_id") == path[i]) & (F.col(f"{name}.dst_community_id") == path[i + 1]))
    tests = (F.col("query_id") != F.col("asked_id"), path[0] != F.col("left_id"), F.element_at(path, -1) != F.col("right_id"), F.array_contains("excluded", path[1]), unknown, ~unknown & off("first", 0), ~unknown & off("second", 1), ~unknown & (F.size("witness_ids") == 0))
    return c.select("candidate_id", F.array_compact(F.array(*(F.when(t, F.lit(e)) for e, t in zip(BRIDGE_ERRORS, tests, strict=True)))).alias("errors"))


def unknown_members(witness: DataFrame, member: DataFrame) -> DataFrame:
    """pg_id and node_uuid of edge ends that are members of no community: direct() drops their edges, so this must be empty."""
    ends = witness.select("pg_id", F.explode(F.array("src_uuid", "dst_uuid")).alias("node_uuid")).distinct()
    return ends.join(member.select("pg_id", "node_uuid"), ["pg_id", "node_uuid"], "left_anti")


def overlapping(pgs: DataFrame) -> DataFrame:
    """Intervals (pg_id, start_ns, end_ns) that begin before all that began earlier have ended: a table of admitted intervals must have none.

    One running maximum over the intervals in order, a small table, in place of a join of all with all."""
    w = Window.orderBy("start_ns", "end_ns", "pg_id").rowsBetween(Window.unboundedPreceding, -1)
    return pgs.withColumn("busy_until", F.max("end_ns").over(w)).where("start_ns < busy_until").select("pg_id", "start_ns", "end_ns", "busy_until")
