"""Every tunable of the engine, in one place. Values are fixed by the data contract."""

from __future__ import annotations

from dataclasses import dataclass

# Earth radius in metres and feet per metre used by every distance.
EARTH_RADIUS_M = 6371000.0
FEET_PER_M = 3.28084
# Planar scale, feet per degree of latitude.
FEET_PER_DEG = 364000.0

# Which neighbour roles may follow each route role.
ROLE_TRANSITIONS = {
    "underground_cable": ("underground_cable", "backbone", "terminal_tail"),
    "backbone": ("underground_cable",),
    "terminal_tail": ("underground_cable",),
}

# Words in a note that mark a field deviation.
DEVIATION_WORDS = (
    "rock", "hard rock", "obstruction", "utility", "conflict", "adjust",
    "offset", "deviation", "avoid", "reroute", "crossing", "issue",
)


@dataclass(frozen=True)
class Grouping:
    min_gap_ft: float = 150.0
    gap_factor: float = 3.5
    default_step_ft: float = 50.0


@dataclass(frozen=True)
class Matching:
    min_length_ratio: float = 0.70
    max_length_ratio: float = 3.50
    keep_ranked: int = 8
    keep_anchored: int = 3
    window_weight: float = 0.35


@dataclass(frozen=True)
class Densify:
    step_ft: float = 60.0
    chunk_ft: float = 60.0


@dataclass(frozen=True)
class Billing:
    material_rate: float = 3.50
    splicing_rate: float = 1.50
    merge_tolerance_ft: float = 5.0


@dataclass(frozen=True)
class Deviation:
    depth_ft: float = 0.5
    boc_ft: float = 1.0
    merge_gap_ft: float = 50.0
    min_length_ft: float = 50.0
    sustained_points: int = 2


@dataclass(frozen=True)
class PointQa:
    """Thresholds for the point flags; the contract names the flags, not the limits."""

    shallow_depth_ft: float = 3.5
    depth_jump_ft: float = 1.5
    station_gap_ft: float = 100.0
    boc_jump_ft: float = 4.0
    off_route_ft: float = 25.0
    wrong_street_ft: float = 40.0
    wrong_street_deg: float = 35.0


@dataclass(frozen=True)
class Snap:
    max_distance_ft: float = 250.0
    node_tolerance_ft: float = 35.0
    min_length_ft: float = 15.0
    max_gap_ft: float = 650.0
    max_length_ft: float = 900.0
    max_stretch: float = 2.0
    stretch_slack_ft: float = 40.0


@dataclass(frozen=True)
class Walk:
    max_accuracy_m: float = 25.0
    max_age_s: float = 8.0
    min_move_m: float = 1.5
    min_interval_s: float = 2.0
    idle_s: float = 1800.0
