"""Thresholds and names that results depend on; builders take a ``Settings`` and never read globals."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

# The metrics of the residual vector, and for true proportions their successes and attempts.
METRICS = (
    "pass_completion_pct",
    "defensive_action_success_pct",
    "mean_action_x",
    "passes_per_90",
    "defensive_actions_per_90",
    "touches_in_defensive_third_per_90",
)
PROPORTIONS = {
    "pass_completion_pct": ("passes_completed", "passes_with_outcome"),
    "defensive_action_success_pct": ("defensive_actions_successful", "defensive_actions_with_outcome"),
}


def data_root(variable: str, project: str | None = None, cache: str | None = None) -> str:
    """Where the data lie: the folder that an environment variable names, else the project's, else the cache's."""
    for found in (os.environ.get(variable), project, cache):
        if found:
            return found.rstrip("/")
    raise LookupError(f"no data folder: set {variable}, or name a project or cache folder")


@dataclass(frozen=True)
class Settings:
    """All knobs, with their published defaults."""

    eligible_minutes: float = 30.0
    mirrored_event_floor: int = 4
    short_goal_kick_max_x: float = 0.3
    baseline_minutes: float = 20.0
    min_matches: int = 5
    flag_rate: float = 0.01
    mad_to_sigma: float = 1.4826
    bootstrap_draws: int = 2000
    trees: int = 50
    borrow_cap: int = 256
    #: Rows of an entity that its forests train on at most; None for all.
    forest_rows: int | None = 1024
    min_spread_rows: int = 4
    seed: int = 20260823
    severities: tuple[float, ...] = (0.0, 1.0, 1.5, 3.0)
    fractions: tuple[float, ...] = (0.0, 0.2, 0.5)
    metrics: tuple[str, ...] = field(default=METRICS)

    def canonical(self) -> str:
        """One text for equal settings; order of metrics counts."""
        return json.dumps(asdict(self), sort_keys=True)


DEFAULT = Settings()
