"""Tunable values of cleaning, motion classification and map matching."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchParams:
    """Defaults that results depend on; lengths in metres, times in milliseconds, angles in degrees."""

    # candidates
    radii: tuple[float, ...] = (40.0, 80.0, 120.0)
    fallback_radii: tuple[float, ...] = (180.0, 260.0)
    complexity_radius: float = 40.0
    fallback_heading: float = 35.0
    fallback_penalty: float = 0.72
    top_simple: int = 4
    top_complex: int = 6
    complex_degree: int = 4
    # probabilities
    sigma_distance: float = 20.0
    sigma_heading: float = 45.0
    route_beta: float = 100.0
    second_beta: float = 120.0
    angle_lambda: float = 2.0
    least_prob: float = 1e-12
    # cleaning
    general_accuracy: float = 200.0
    driving_accuracy: float = 120.0
    walking_accuracy: float = 180.0
    driving_speed: float = 35.0
    driving_step: float = 250.0
    jump_speed: float = 55.0
    dedup_ms: int = 1000
    dedup_m: float = 2.0
    walk_spike_speed: float = 7.5
    # motion
    near_road: float = 18.0
    off_road: float = 30.0
    road_search: float = 60.0
    drive_median: float = 3.8
    drive_max: float = 6.5
    walk_median: float = 2.2
    walk_max: float = 4.2
    least_run_points: int = 4
    least_run_ms: int = 45_000
    # stays and walking
    stay_m: float = 12.0
    stay_ms: int = 20_000
    stay_speed: float = 1.5
    walk_stay_m: float = 10.0
    walk_stay_ms: int = 15_000
    walk_stay_speed: float = 1.2
    walk_move_m: float = 4.0
    walk_idle_ms: int = 30_000
    walk_turn: float = 28.0
    # reconstruction
    line_steps: int = 8
    same_road_steps: int = 3
    detour_ratio: float = 3.2
    detour_extra: float = 220.0
    most_nodes: int = 12
    least_step_m: float = 2.0
    hard_block: float = 120.0
    corridor_angle: float = 25.0
    corridor_m: float = 120.0
    handoff_m: float = 35.0
    same_way_handoff_m: float = 90.0
    handoff_share: float = 0.92
    # the box of roads around a track
    least_radius_km: float = 1.5
    box_buffer_km: float = 4.0
    # half the width of the corridor of roads within it; as wide as the smallest box
    corridor_km: float = 5.5
    # roads of one corridor, and changes of level on it
    family_angle: float = 15.0
    family_apart_m: float = 35.0
    seen_weights: tuple[float, float, float] = (0.45, 0.35, 0.2)
    evidence_weights: tuple[float, float, float] = (0.45, 0.35, 0.2)
    seen_close_m: float = 25.0
    way_slack_m: float = 40.0
    joint_m: float = 20.0
    near_joint_m: float = 35.0
    link_scores: tuple[float, float, float] = (0.85, 0.6, 0.65)
    weak_access: float = 0.75
    change_rates: tuple[float, float, float] = (2.05, 2.1, 3.2)
    least_factors: tuple[float, float] = (0.1, 0.03)
    stay_reward: float = 0.18
    settle_reward: float = 0.75
    # switches
    use_sensor_fields: bool = True
    quality_fallback: bool = False


#: Colours and widths of drawn segments.
COLORS = {("matched", "DRIVING"): "#FF9500", ("matched", "WALKING"): "#34C759", ("reconstructed", "DRIVING"): "#007AFF", ("reconstructed", "WALKING"): "#22C55E"}
WIDTHS = {"matched": 4, "reconstructed": 6}

DEFAULTS = MatchParams()
