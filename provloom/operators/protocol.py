"""Checks of an experiment's settings before anything runs."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain, pairwise
from typing import Any

# Phases in order of time, and flags that must be off.
PHASES = ("fit_days", "calibration_days", "development_days", "context_days", "locked_test_days")
LABEL_FLAGS = ("use_labels_for_training", "use_labels_for_benign_calibration", "use_locked_labels_for_model_selection", "global_uuid_is_positive")
FEATURE_FLAGS = ("allow_raw_uuid_as_model_feature", "allow_global_node_malicious_label", "allow_future_events_in_features", "allow_cross_boundary_windows")


def check_split(settings: Mapping[str, Any]) -> None:
    """Raise ValueError unless the split is frozen, no flag that leaks is on, and phases hold whole days, each once, in order, together all of the dataset's."""
    split = settings["ca3_primary_split"]
    if settings["ca3_split_policy"]["status"] != "frozen":
        raise ValueError("the split must be frozen")
    for part, flags in ((settings["label_policy"], LABEL_FLAGS), (split["feature_policy"], FEATURE_FLAGS)):
        if on := [f for f in flags if part[f]]:
            raise ValueError(f"unsafe flags are on: {on}")
    days = {p: split[p] for p in PHASES}
    for phase, own in days.items():
        if not isinstance(own, (list, tuple)) or not own:
            raise ValueError(f"{phase} must be a list of days")
        if len(set(own)) < len(own):
            raise ValueError(f"{phase} has a day twice")
    every = list(chain.from_iterable(days.values()))
    if twice := sorted({d for d in every if every.count(d) > 1}):
        raise ValueError(f"phases overlap on {twice}")
    for (a, x), (b, y) in pairwise(days.items()):
        if min(y) <= max(x):
            raise ValueError(f"{b} must come after {a}")
    first, last = settings["dataset"]["day_graph_range"]
    if odd := sorted(set(every) ^ set(range(first, last + 1))):
        raise ValueError(f"days missing from the split or from the dataset: {odd}")
