"""Parameters of the engine, each under the name of what it decides."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    new_detection_score: float = 0.4
    cover_limit: float = 0.80
    min_fill_ratio: float = 0.10
    min_track_frames: int = 3
    min_box_side: int = 10
    box_padding: float = 0.2
    frame_step: int = 1
    covisible_frames: int = 3
    reid_threshold: float = 0.65
    ema_alpha: float = 0.9
    retry_window: int = 5
    min_body_fit: float = 0.30
    cross_view_threshold: float = 0.4
    appearance_weight: float = 0.7
    shape_weight: float = 0.3
    dtw_exponent: float = 2.0
    min_correspondences: int = 30
    window: int = 128
    stride: int = 64
    default_focal: float = 1000.0
    max_crop_shift: int = 30
    max_side: int = 1440
    rotation_threshold_deg: float = 15.0
    centre_threshold_pct: float = 15.0


DEFAULT = Config()

#: Where a setting of a configuration file goes.
SETTINGS = {
    ("data", "rich_max_side"): "max_side",
    ("segmentation", "new_det_thresh"): "new_detection_score",
    ("parameters_extraction", "reid_threshold"): "reid_threshold",
    ("parameters_extraction", "gallery_moving_average_alpha"): "ema_alpha",
    ("parameters_extraction", "reid_match_window"): "retry_window",
    ("parameters_extraction", "sam3d_step"): "frame_step",
    ("parameters_extraction", "bbox_padding"): "box_padding",
    ("parameters_extraction", "cross_view_reid_threshold"): "cross_view_threshold",
    ("parameters_extraction", "cross_view_appearance_weight"): "appearance_weight",
    ("parameters_extraction", "cross_view_shape_weight"): "shape_weight",
}


def from_yaml(text: str, base: Config = DEFAULT) -> Config:
    """A configuration file's settings over the defaults; what it does not name, or sets to null, stays."""
    import yaml

    read = yaml.safe_load(text) or {}
    found = {name: (read.get(section) or {}).get(key) for (section, key), name in SETTINGS.items()}
    return replace(base, **{name: value for name, value in found.items() if value is not None})

# The parent of each of the 55 body joints; the root has none (-1).
JOINT_PARENTS = [
    -1, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 9, 12, 13, 14, 16, 17, 18, 19,
    15, 15, 15,
    20, 25, 26, 20, 28, 29, 20, 31, 32, 20, 34, 35, 20, 37, 38,
    21, 40, 41, 21, 43, 44, 21, 46, 47, 21, 49, 50, 21, 52, 53,
]
