"""Pattern matching over evidence and decision tables."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Networks whose addresses are not outside ones (private, loopback, link-local, multicast, unspecified), and exceptions among them.
INSIDE = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10", "ff00::/8",
)
OUTSIDE = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def external_flow(entity_type: Column, remote_address: Column, local_networks: tuple[str, ...] = ()) -> Column:
    """Whether an entity is a flow from or to an outside address. A text that is no address is an error; networks must have no host bits."""
    inside, outside, local = ([ipaddress.ip_network(n) for n in each] for each in (INSIDE, OUTSIDE, local_networks))

    @F.pandas_udf("boolean")
    def public(address: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool:
            if not text:
                return False
            a = ipaddress.ip_address(text)
            holds = lambda networks: any(a in n for n in networks if n.version == a.version)
            return not holds(local) and (not holds(inside) or holds(outside))

        return address.map({t: one(t) for t in address.unique()}).astype(bool)

    return F.coalesce(entity_type == "NET_FLOW", F.lit(False)) & public(F.when(entity_type == "NET_FLOW", remote_address))


# Event types of the three steps, statuses from the weakest on with their reasons, and the text to search techniques with.
INGRESS = ("EVENT_ACCEPT", "EVENT_RECVFROM", "EVENT_RECVMSG")
CALLBACK = ("EVENT_CONNECT", "EVENT_SENDTO", "EVENT_SENDMSG")
STATUSES = ("attempted", "probable", "supported")
HORIZON_REASONS = ("boundary_ingress_only", "boundary_ingress_with_partial_consequence", "boundary_ingress_callback_and_local_effect")
SCOPE_REASONS = ("boundary_ingress_only", "boundary_ingress_with_linked_partial_consequence", "boundary_ingress_callback_and_ordered_local_effect")
HORIZON_QUERY = "exploit public-facing web server for initial access"
SCOPE_QUERY = "exploit public-facing service for initial access"


def assessment(atoms: DataFrame, entities: DataFrame, ports: tuple[int, ...] = (80, 443), callback_ns: int | None = None, effect_ns: int | None = None) -> DataFrame:
    """Entry through a public service, per scope.

    atoms: scope_id, src, dst, event_type, timestamp_ns, evidence_id, community_id; entities: entity_id, entity_type, external (see
    external_flow), local_port. With horizons, a callback counts within callback_ns of its entry, and a write and its execute within
    effect_ns (of equal entries the larger evidence id wins); without, by order inside the scope alone (the smaller one wins).
    Returns scope_id, assessment_id, status (conflicted, absent, attempted, probable, supported), entry_subject_id, entry_flow_id,
    first_local_subject_id, community_ids, evidence_ids, reason_codes, attack_query.

    What comes first after an event is a minimum over the rows that follow it, so nothing is paired: an effect in time exists if the
    earliest execute of all later effects is in time. Only the best entry of a scope then looks up its write.
    """
    bounded = callback_ns is not None

    def facts(p: str) -> DataFrame:
        return entities.select(F.col("entity_id").alias(p), F.col("entity_type").alias(f"{p}_type"), F.col("external").alias(f"{p}_external"), F.col("local_port").alias(f"{p}_port"))

    a = atoms.join(facts("src"), "src", "left").join(facts("dst"), "dst", "left")
    bad = (F.col("timestamp_ns") < 0) | F.col("src_type").isNull() | F.col("dst_type").isNull()
    conflicts = a.where(bad).groupBy("scope_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("bad_ids"))
    it, process = F.col("event_type"), "SUBJECT_PROCESS"
    atom = F.struct("timestamp_ns", "evidence_id", "dst", "community_id")

    def later(key: str):
        return Window.partitionBy("scope_id", key).orderBy("timestamp_ns").rangeBetween(Window.currentRow, Window.unboundedFollowing)

    wrote, ran = (it == "EVENT_WRITE") & F.col("dst_type").startswith("FILE_OBJECT"), (it == "EVENT_EXECUTE") & (F.col("dst_type") == process)
    files = a.where(wrote | ran).withColumn("file", F.when(wrote, F.col("dst")).otherwise(F.col("src"))).withColumn("x", F.min(F.when(ran, atom)).over(later("file")))
    columns = ["scope_id", "timestamp_ns", "evidence_id", "dst", "src", "community_id"]
    effects = files.where(wrote & F.col("x").isNotNull()).select(*columns, F.col("src").alias("who"), F.lit("effect").alias("part"), "x")
    called = it.isin(*CALLBACK) & F.col("dst_external")
    entered = it.isin(*INGRESS) & F.col("src_external") & F.col("src_port").isin(*ports) & (F.col("dst_type") == process)
    none = F.lit(None).cast(files.schema["x"].dataType).alias("x")
    steps = effects.unionByName(a.where(called).select(*columns, F.col("src").alias("who"), F.lit("callback").alias("part"), none)).unionByName(a.where(entered).select(*columns, F.col("dst").alias("who"), F.lit("entry").alias("part"), none))
    is_effect = F.col("part") == "effect"
    steps = steps.withColumns({"callback": F.min(F.when(F.col("part") == "callback", atom)).over(later("who")), "done_ns": F.min(F.when(is_effect, F.col("x.timestamp_ns"))).over(later("who"))})
    t = F.col("timestamp_ns")
    in_time = (F.col("callback.timestamp_ns") <= t + callback_ns) if bounded else F.lit(True)
    callback = F.when(in_time, F.col("callback"))
    effect = (F.col("done_ns") <= t + effect_ns) if bounded else F.col("done_ns").isNotNull()
    rank = callback.isNotNull().cast("int") + F.coalesce(effect, F.lit(False)).cast("int") + 1
    entries = steps.where("part = 'entry'").select("scope_id", rank.alias("rank"), "timestamp_ns", "evidence_id", "dst", "src", "community_id", callback.alias("callback"))
    order = (F.max(F.struct("rank", (-t).alias("t"), "evidence_id", "dst", "src", "community_id", "callback")) if bounded else F.min(F.struct((-F.col("rank")).alias("r"), t.alias("t"), "evidence_id", "dst", "src", "community_id", "callback"))).alias("b")
    best = entries.groupBy("scope_id").agg(order).select("scope_id", (F.col("b.rank") if bounded else -F.col("b.r")).alias("rank"), (-F.col("b.t") if bounded else F.col("b.t")).alias("entry_ns"), F.col("b.dst").alias("who"), "b.src", "b.evidence_id", "b.community_id", "b.callback")
    own = effects.select("scope_id", "who", F.struct(t.alias("timestamp_ns"), "evidence_id", "community_id", "x").alias("e"))
    fits = (F.col("e.timestamp_ns") >= F.col("entry_ns")) & ((F.col("e.x.timestamp_ns") <= F.col("entry_ns") + effect_ns) if bounded else F.lit(True))
    written = best.join(own, ["scope_id", "who"]).where(fits).groupBy("scope_id").agg(F.min("e").alias("effect"))
    out = atoms.select("scope_id").distinct().join(conflicts, "scope_id", "left").join(best, "scope_id", "left").join(written, "scope_id", "left")
    some = lambda field: F.array_compact(F.array(F.col(field), F.col(f"callback.{field}"), F.col(f"effect.{field}"), F.col(f"effect.x.{field}")))
    fine, empty = F.col("bad_ids").isNull(), F.array().cast("array<string>")
    found = fine & F.col("rank").isNotNull()
    named = lambda names: F.element_at(F.array(*map(F.lit, names)), F.coalesce(F.col("rank"), F.lit(1)))
    out = out.select(
        "scope_id", F.when(~fine, "conflicted").when(~found, "absent").otherwise(named(STATUSES)).alias("status"), F.when(found, F.col("who")).alias("entry_subject_id"), F.when(found, F.col("src")).alias("entry_flow_id"),
        F.when(found, F.coalesce("effect.x.dst", "who")).alias("first_local_subject_id"), F.when(found, F.array_sort(F.array_distinct(some("community_id")))).otherwise(empty).alias("community_ids"),
        F.when(~fine, F.col("bad_ids")).when(found, F.array_sort(some("evidence_id"))).otherwise(empty).alias("evidence_ids"),
        F.array(F.when(~fine, "invalid_evidence_reference").when(~found, "no_boundary_ingress").otherwise(named(HORIZON_REASONS if bounded else SCOPE_REASONS))).alias("reason_codes"), F.when(found, HORIZON_QUERY if bounded else SCOPE_QUERY).alias("attack_query"),
    )
    # the id is of compact JSON with sorted keys
    body = F.when(F.col("status") == "absent", F.to_json(F.struct("status"))).when(F.col("status") == "conflicted", F.to_json(F.struct("evidence_ids", "status"))).otherwise(F.to_json(F.struct("entry_subject_id", "evidence_ids", "status")))
    return out.select("scope_id", F.concat(F.lit("ic-"), F.substring(F.sha2(body, 256), 1, 20)).alias("assessment_id"), *out.columns[1:])


# Kinds of open frontiers in the order in which the first is named on an exhausted budget.
FRONTIER_KINDS = ("connectivity", "entry", "validation")


def decide(states: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Action of each state: state_id, action, reason, frontier_id, terminal.

    states: state_id, ic_status, earlier_scope, remaining, entry_connected, transitions_witnessed; frontiers: state_id, frontier_id, kind
    (validation, connectivity, entry), reason, critical, status. Of a kind the open critical one with the smallest id counts.
    """
    one = F.struct("frontier_id", F.col("reason").alias("why"))
    open_ = frontiers.where("critical and status = 'open'").groupBy("state_id").agg(F.min(F.struct("kind", "frontier_id")).alias("any"), *(F.min(F.when(F.col("kind") == k, one)).alias(k) for k in FRONTIER_KINDS))
    s = states.join(open_, "state_id", "left")

    def row(action, reason, item=None, terminal=False):
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(text(action).alias("action"), text(reason).alias("reason"), (F.lit(None).cast("string") if item is None else item).alias("frontier_id"), F.lit(terminal).alias("terminal"))

    supported, entry = F.col("ic_status") == "supported", F.col("entry.frontier_id")
    # the table's rows, from the first that applies
    out = F.when(supported & F.col("entry_connected") & F.col("transitions_witnessed") & F.col("any").isNull(), row("terminate", "entry_boundary_resolved", None, True))
    out = out.when(F.col("remaining") <= 0, row("suspend", "action_budget_exhausted", F.col("any.frontier_id"), True))
    out = out.when((F.col("ic_status") == "conflicted") | F.col("validation").isNotNull(), row("continue", "bounded_verification_required", F.col("validation.frontier_id")))
    out = out.when(F.col("connectivity").isNotNull(), row("retrieve_bridge", F.col("connectivity.why"), F.col("connectivity.frontier_id")))
    out = out.when(~F.col("transitions_witnessed"), row("suspend", "unmaterialized_connectivity_frontier", None, True))
    out = out.when(~supported & F.col("earlier_scope"), row("extend_left", "entry_boundary_unresolved", entry)).when(~supported, row("suspend", "earlier_evidence_unavailable", entry, True))
    out = out.when(~F.col("entry_connected"), row("suspend", "supported_entry_not_connected_to_backbone", None, True))
    out = out.when(entry.isNotNull(), row("suspend", "inconsistent_open_entry_frontier", entry, True)).otherwise(row("suspend", "unresolved_investigation_state", None, True))
    return s.select("state_id", out.alias("d")).select("state_id", "d.*")


def path_validation(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """For each path (path_id, community_ids) and its steps (path_id, position from 0, src, dst, role, semantics, witnesses: how many): whether it is
    connected, witnessed and free of identity steps in the role of attack transitions; valid, and the reasons against it in order."""
    here = steps.join(paths, "path_id")
    fits = (F.col("src") == F.try_element_at("community_ids", F.col("position") + 1)) & (F.col("dst") == F.try_element_at("community_ids", F.col("position") + 2))
    g = here.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(fits, F.lit(False))).alias("fits"), F.bool_and(F.col("witnesses") > 0).alias("witnessed"), F.bool_and((F.col("role") != "attack_transition") | (F.col("semantics") == "causal_event")).alias("causal"))
    out = paths.join(g, "path_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(True))
    connected = (F.size("community_ids") == 1) | ((F.coalesce("n", F.lit(0)) == F.size("community_ids") - 1) & yes("fits"))
    out = out.select("path_id", connected.alias("connected"), yes("witnessed").alias("witnessed"), yes("causal").alias("causal"))
    reasons = F.array_compact(F.array(F.when(~F.col("connected"), "entry_to_seed_path_disconnected"), F.when(~F.col("witnessed"), "unwitnessed_retained_edge"), F.when(~F.col("causal"), "identity_edge_promoted_to_attack_transition")))
    return out.withColumns({"valid": F.col("connected") & F.col("witnessed") & F.col("causal"), "reason_codes": reasons})


def stitch_chain(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Per path: identity steps that share no entity with the latest valid identity step (or the start's entities).
    steps: path_id, position, edge_id, semantics, entities (array); starts: path_id, entities. Causal steps do not count."""
    mine = steps.where("semantics = 'identity_continuity'").groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("position", "edge_id", "entities"))).alias("chain"))
    rows = starts.select("path_id", F.col("entities").alias("eligible")).join(mine, "path_id", "left")
    first = F.struct(F.col("eligible"), F.array().cast("array<string>").alias("invalid"))

    def step(acc, x):
        fits = F.coalesce(F.arrays_overlap(acc["eligible"], x["entities"]), F.lit(False))
        return F.struct(F.when(fits, x["entities"]).otherwise(acc["eligible"]).alias("eligible"), F.when(fits, acc["invalid"]).otherwise(F.array_append(acc["invalid"], x["edge_id"])).alias("invalid"))

    done = F.coalesce(F.aggregate("chain", first, step), first)
    return rows.select("path_id", (F.size(done["invalid"]) == 0).alias("valid"), done["invalid"].alias("invalid_edge_ids"))


# The reasons below, and kinds of open items that ask for more scope, in order, each with its action.
SCOPE_GAPS = {"left_time": "extend_left", "right_time": "extend_right", "host_scope": "extend_host"}


def next_action(states: DataFrame, items: DataFrame) -> DataFrame:
    """Action of each state: state_id, action, reason, item_id, terminal.

    states: state_id, ic_status, remaining, can_left, can_right, can_host (more scope there); items: state_id,
    item_id, gap_type, status, critical, direction, reason. Of a kind, the open critical item with the smallest id
    counts. One aggregation makes those first items columns; the rest is a decision table.
    """
    one = F.struct("item_id", F.col("reason").alias("why"), "direction")
    kinds = ("evidence_integrity", "connectivity", "entry", "stage_constraint", *SCOPE_GAPS, "competition")
    firsts = items.where("critical and status = 'open'").groupBy("state_id").agg(F.min(one).alias("any"), *(F.min(F.when(F.col("gap_type") == k, one)).alias(k) for k in kinds))
    s = states.join(firsts, "state_id", "left")
    status, entry = F.col("ic_status"), F.col("entry.item_id")

    def row(action, reason, item, terminal: bool = False):
        as_column = lambda x: x if not isinstance(x, str) else F.lit(x)
        return F.struct(as_column(action).alias("action"), as_column(reason).alias("reason"), F.lit(item).cast("string").alias("item_id") if item is None else item.alias("item_id"), F.lit(terminal).alias("terminal"))

    def of(kind: str, action) -> object:
        return row(action, F.col(f"{kind}.why"), F.col(f"{kind}.item_id"))

    def room(direction):
        return F.when(direction == "left", F.col("can_left")).when(direction == "right", F.col("can_right")).when(direction == "host", F.col("can_host")).otherwise(False)

    stage = F.col("stage_constraint.direction")
    out = F.when(F.col("any").isNull() & (status == "supported"), row("stop_complete", "ic_supported_and_frontier_closed", None, True))
    out = out.when(F.col("remaining") <= 0, row("stop_limited", "action_budget_exhausted", F.col("any.item_id"), True))
    out = out.when((status == "conflicted") | F.col("evidence_integrity").isNotNull(), row("verify_claim", "invalid_or_conflicting_evidence", F.col("evidence_integrity.item_id")))
    out = out.when(F.col("connectivity").isNotNull(), of("connectivity", "retrieve_bridge"))
    out = out.when((status == "absent") & F.col("can_left"), row("extend_left", "entry_not_observed", entry)).when((status == "absent") & F.col("can_host"), row("extend_host", "entry_may_be_cross_host", entry)).when(status == "absent", row("stop_limited", "entry_evidence_unavailable", entry, True))
    part = status.isin("attempted", "probable")
    out = out.when(part & F.col("can_right"), row("extend_right", "entry_success_not_yet_evidenced", entry)).when(part, row("stop_limited", "entry_consequence_unavailable", entry, True))
    has = F.col("stage_constraint").isNotNull()
    out = out.when(has & ((stage == "none") | room(stage)), of("stage_constraint", F.when(stage == "none", "verify_claim").otherwise(F.concat(F.lit("extend_"), stage)))).when(has, row("stop_limited", "stage_evidence_unavailable", F.col("stage_constraint.item_id"), True))
    for kind, action in SCOPE_GAPS.items():
        out = out.when(F.col(kind).isNotNull() & room(F.col(f"{kind}.direction")), of(kind, action)).when(F.col(kind).isNotNull(), row("stop_limited", "frontier_scope_unavailable", F.col(f"{kind}.item_id"), True))
    out = out.when(F.col("competition").isNotNull(), of("competition", "verify_claim")).when(F.col("any").isNotNull(), of("any", "verify_claim")).otherwise(row("stop_limited", "initial_compromise_not_supported", None, True))
    return s.select("state_id", out.alias("d")).select("state_id", "d.*")
