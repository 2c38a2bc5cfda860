"""A small predictor of each group of a signature's target from the context, with the channels that give the group away masked."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of target coordinates by the prefix of their names, and prefixes of the context channels masked for each.
GROUPS = {"behavior:": ("incoming_relation:", "outgoing_relation:"), "role:": ("incoming_relation:", "outgoing_relation:"), "temporal:": (), "structure:": ("context:log_",)}


def signature_groups(context_names: list[str], target_names: list[str]) -> tuple[list[list[int]], np.ndarray]:
    """Coordinates of each group, and for each group which context channels it may see (1) or not (0). Every target belongs to one group, no group is empty."""
    groups = [[i for i, n in enumerate(target_names) if n.startswith(p)] for p in GROUPS]
    if sorted(sum(groups, [])) != list(range(len(target_names))) or not all(groups):
        raise ValueError("each target coordinate must belong to exactly one group, and no group may be empty")
    return groups, np.array([[float(not n.startswith(hidden or ("\0",))) for n in context_names] for hidden in GROUPS.values()])


@dataclass
class Predictor:
    """One hidden layer that the groups share, and a linear head for each group."""

    groups: list[list[int]]
    masks: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray]
    heads: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def new(cls, context_names: list[str], target_names: list[str], width: int = 64, seed: int = 0) -> Predictor:
        groups, masks = signature_groups(context_names, target_names)
        rng = np.random.default_rng(seed)

        def layer(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            limit = 1 / np.sqrt(a)
            return rng.uniform(-limit, limit, (a, b)), rng.uniform(-limit, limit, b)

        return cls(groups, masks, layer(len(context_names), width), [layer(width, len(g)) for g in groups])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), sum(map(len, self.groups))))
        for mask, g, (w, b) in zip(self.masks, self.groups, self.heads, strict=True):
            out[:, g] = np.maximum((x * mask) @ self.hidden[0] + self.hidden[1], 0) @ w + b
        return out

    def loss(self, predicted: np.ndarray, target: np.ndarray) -> float:
        """Mean over groups of the smooth L1 loss."""
        d = np.abs(predicted - target)
        smooth = np.where(d < 1, d * d / 2, d - 0.5)
        return float(np.mean([smooth[:, g].mean() for g in self.groups]))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, size: int = 8192, rate: float = 1e-3, decay: float = 1e-4, seed: int = 0) -> Predictor:
        """Adam with decoupled weight decay over shuffled batches."""
        rng = np.random.default_rng(seed)
        weights = [*self.hidden, *(p for head in self.heads for p in head)]
        first, second, step = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), size):
                at, step = order[i : i + size], step + 1
                for k, g in enumerate(self._gradients(x[at], y[at])):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    weights[k] -= rate * (move + decay * weights[k])  # in place
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        shared, heads = [np.zeros_like(p) for p in self.hidden], []
        for mask, g, (w, b) in zip(self.masks, self.groups, self.heads, strict=True):
            seen = x * mask
            inner = seen @ self.hidden[0] + self.hidden[1]
            active = np.maximum(inner, 0)
            slope = np.clip(active @ w + b - y[:, g], -1, 1) / (len(x) * len(g) * len(self.groups))
            back = (slope @ w.T) * (inner > 0)
            shared[0] += seen.T @ back
            shared[1] += back.sum(axis=0)
            heads += [active.T @ slope, slope.sum(axis=0)]
        return [*shared, *heads]


def fit_predictor(signed: DataFrame, context_names: list[str], target_names: list[str], rows: int = 200_000, epochs: int = 4, width: int = 64, seed: int = 0, size: int = 8192, rate: float = 1e-3) -> Predictor:
    """A predictor trained on at most `rows` rows of signatures (context, target; pg_id and node_uuid order them), those whose hash comes first: a bounded sample, the same on every run."""
    picked = signed.select("context", "target", F.xxhash64(F.lit(seed), "pg_id", "node_uuid").alias("h")).orderBy("h").limit(rows).toPandas()
    model = Predictor.new(context_names, target_names, width, seed)
    return model.train(np.stack(picked["context"]), np.stack(picked["target"]), epochs, size, rate, seed=seed) if len(picked) else model


def residuals(signed: DataFrame, model: Predictor) -> DataFrame:
    """signed with residual: target minus prediction, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def missed(context: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(target) - model.predict(np.stack(context)))) if len(context) else pd.Series([], dtype=object)

    return signed.withColumn("residual", missed("context", "target"))
