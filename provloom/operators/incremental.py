"""Insertion of intervals into a memory graph that exists already, in any order of time."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fmg
from .shared import settled


@dataclass(frozen=True)
class State:
    """Tables of admitted intervals: pgs (pg_id, start_ns, end_ns, candidate and split columns), members, occurrences, direct witness rows, and continuation witness rows with their pair of intervals."""

    pgs: DataFrame
    members: DataFrame
    occurrences: DataFrame
    direct: DataFrame
    stitches: DataFrame

    def witnesses(self) -> DataFrame:
        return self.direct.unionByName(self.stitches.drop("pg_id", "right_pg"))


def insert(state: State | None, pgs: DataFrame, members: DataFrame, witness: DataFrame, candidate_ns: int | None = None) -> State:
    """The state with new intervals, their members and their witnesses. An interval that is there already or overlaps another is an error.

    Only pairs of neighbours with a new interval are joined. Stored stitches stay unless a new interval has come between their two;
    nothing older is computed again, so the cost is that of the new intervals and their neighbours, earlier or later.
    """
    every = settled(pgs if state is None else state.pgs.unionByName(pgs))
    if not every.groupBy("pg_id").count().where("count > 1").isEmpty():
        raise ValueError("an interval is admitted already")
    if not fmg.overlapping(every).isEmpty():
        raise ValueError("admitted intervals overlap")
    seen = fmg.occurrences(witness)
    all_members = members if state is None else state.members.unionByName(members)
    all_seen = seen if state is None else state.occurrences.unionByName(seen)
    pairs = fmg.adjacent(every, candidate_ns)
    new = pgs.select("pg_id")
    fresh = pairs.join(new, "pg_id", "left_semi").unionByName(pairs.join(new, "pg_id", "left_anti").join(new.withColumnRenamed("pg_id", "right_pg"), "right_pg", "left_semi").select(pairs.columns))
    near = fresh.select(F.explode(F.array("pg_id", "right_pg")).alias("pg_id")).distinct()  # only their rows take part
    made = fmg.stitched(fresh, all_members.join(near, "pg_id", "left_semi"), all_seen.join(near, "pg_id", "left_semi"))
    direct = fmg.direct(witness, members)
    if state is not None:
        kept = state.stitches.join(pairs.select("pg_id", "right_pg"), ["pg_id", "right_pg"], "left_semi")
        made, direct = made.unionByName(kept.select(made.columns)), state.direct.unionByName(direct)
    out = State(every, all_members, all_seen, direct, made)
    return replace(out, **{f.name: settled(getattr(out, f.name)) for f in fields(out) if f.name != "pgs"})


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order and partitions: columns by name, rows as JSON with nulls, their SHA-256 added up in four parts."""
    text = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    r = df.select(F.sha2(text, 256).alias("h")).agg(F.count(F.lit(1)), *map(part, range(4))).first()
    return hashlib.sha256("|".join(str(x) for x in r).encode()).hexdigest()


def signature(state: State) -> str:
    """One hash of members, relations and witnesses: equal for equal content, however it was inserted."""
    w = state.witnesses()
    return hashlib.sha256("".join(map(content_hash, (state.pgs, state.members, fmg.relations(w), fmg.indexed(w)))).encode()).hexdigest()
