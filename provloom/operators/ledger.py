"""Ledgers of investigations: hash-chained entries, each checked against the state that those before it make."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def digest(value: Any) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class Ledger:
    """Entries with the state they lead to. Appending costs one step: the state is kept, never made anew."""

    def __init__(self, communities: Iterable[str], entries: Iterable[dict] = ()) -> None:
        self.entries: list[dict] = []
        self.state: dict[str, Any] = {"ledger_offset": -1, "backbone_community_ids": sorted(set(communities)), "backbone_edge_ids": [], "open_gaps": {}, "retrieved_candidates": {}, "next_action": "inspect_frontier", "action_reason_gap_id": None}
        self._seal()
        for e in entries:
            self.accept(e)

    def _seal(self) -> None:
        self.state.pop("snapshot_hash", None)
        self.state["snapshot_hash"] = digest(self.state)

    def accept(self, entry: dict) -> None:
        if entry["input_snapshot_hash"] != self.state["snapshot_hash"]:
            raise ValueError(f"entry {entry['offset']} does not follow the state before it")
        step = getattr(self, f"_{entry['event_type']}", None)
        if step is None:
            raise ValueError(f"unknown entry {entry['event_type']}")
        step(entry["payload"])
        self.state["ledger_offset"] = entry["offset"]
        self._seal()
        self.entries.append(entry)

    def append(self, event_type: str, actor: str, round_index: int, payload: dict) -> dict:
        entry = {"offset": len(self.entries), "event_type": event_type, "actor": actor, "round": round_index, "input_snapshot_hash": self.state["snapshot_hash"], "payload": dict(payload)}
        entry["event_id"] = "ledger-" + digest(entry)[:24]
        self.accept(entry)
        return entry

    def _next(self, action: str, *gap: str | None) -> None:
        self.state["next_action"] = action
        if gap:
            (self.state["action_reason_gap_id"],) = gap

    def _gap_opened(self, p: dict) -> None:
        self.state["open_gaps"][p["gap_id"]] = dict(p)
        self._next("retrieve_bridge", p["gap_id"])

    def _bridge_query_issued(self, p: dict) -> None:
        if p["gap_id"] not in self.state["open_gaps"]:
            raise ValueError("a query needs an open gap")

    def _bridge_candidate_retrieved(self, p: dict) -> None:
        self.state["retrieved_candidates"][p["candidate_id"]] = dict(p)
        self._next("verify_claim")

    def _bridge_candidate_rejected(self, p: dict) -> None:
        self.state["retrieved_candidates"].pop(p["candidate_id"], None)
        self._next("retrieve_bridge")

    def _bridge_candidate_accepted(self, p: dict) -> None:
        if p["candidate_id"] not in self.state["retrieved_candidates"]:
            raise ValueError("only a retrieved candidate can be accepted")
        for name, more in (("backbone_community_ids", p["community_path"]), ("backbone_edge_ids", p["edge_path"])):
            self.state[name] = sorted({*self.state[name], *more})
        self.state["open_gaps"].pop(p["gap_id"], None)
        self._next("inspect_frontier", None)

    def _stop_recorded(self, p: dict) -> None:
        self._next(p["action"], p.get("gap_id"))


def replay(entries: DataFrame) -> DataFrame:
    """Final state (JSON) or error of each investigation. entries: investigation_id, communities (array), offset, entry (JSON)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        state = error = None
        try:
            state = json.dumps(Ledger(list(pdf["communities"].iloc[0]), map(json.loads, pdf["entry"])).state, sort_keys=True)
        except (ValueError, KeyError) as e:
            error = str(e)
        return pd.DataFrame({"investigation_id": [pdf["investigation_id"].iloc[0]], "state": [state], "error": [error]})

    return entries.groupBy("investigation_id").applyInPandas(run, "investigation_id string, state string, error string")
