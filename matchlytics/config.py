"""Typed defaults of every operator parameter.

Fixed values: thresholds, weights, word lists and layouts below have to equal the published
defaults for results to agree, so they are stated as they are.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

# Detector order of a match's signal list (decides ties in time).
DETECTOR_ORDER = ("audio", "scene", "scoreboard_ocr", "commentary", "action_spotting")

# Weight of each signal source. "scene" signals have no weight of their own
# (the key is "scene_replay"), so they add nothing unless the caller adds a "scene" entry.
WEIGHTS = {
    "action_spotting": 1.2,
    "scoreboard_ocr": 1.0,
    "audio": 0.6,
    "commentary": 0.5,
    "scene_replay": 0.4,
}

# Commentary keywords by kind, in match order.
KEYWORDS = {
    "goal": ["goal", "scores", "what a", "gol", "golazo", "gooal", "unbelievable", "screamer"],
    "chance": ["chance", "close", "saved", "off the bar", "post", "denied"],
    "card": ["red card", "sent off", "penalty", "var", "free kick"],
}

# Spotted label -> moment kind.
LABEL_MAP = {
    "goal": "goal",
    "shot": "chance",
    "shots on target": "chance",
    "shots off target": "chance",
    "save": "save",
    "penalty": "goal",
    "yellow card": "card",
    "red card": "card",
    "direct free-kick": "chance",
    "corner": "chance",
}

# Words that mark a tool-log line as an error line.
LOG_KEYWORDS = ("error", "invalid", "no such", "unable", "failed",
                "not found", "cannot", "does not", "conversion failed")

# Video file suffixes.
VIDEO_SUFFIXES = (".mp4", ".mkv", ".mov", ".m4v", ".avi", ".webm", ".ts")

# Pitch of 105 x 68 m and its named landmarks in keypoint-channel order.
PITCH_LENGTH = 105.0
PITCH_WIDTH = 68.0
BOX_WIDTH = 40.32
BOX_DEPTH = 16.5
SPOT_DEPTH = 11.0


def pitch_landmarks() -> list[tuple[int, str, float, float]]:
    """(channel, name, x, y) in metres, origin at the top-left corner."""
    x0, xm, x1 = 0.0, PITCH_LENGTH / 2, PITCH_LENGTH
    y0, ym, y1 = 0.0, PITCH_WIDTH / 2, PITCH_WIDTH
    top, bottom = (PITCH_WIDTH - BOX_WIDTH) / 2, (PITCH_WIDTH + BOX_WIDTH) / 2
    # Names and order.
    points = [
        ("tl_corner", x0, y0), ("tr_corner", x1, y0), ("br_corner", x1, y1), ("bl_corner", x0, y1),
        ("halfway_top", xm, y0), ("halfway_bottom", xm, y1), ("center", xm, ym),
        ("l_box_tl", x0, top), ("l_box_bl", x0, bottom),
        ("l_box_tr", BOX_DEPTH, top), ("l_box_br", BOX_DEPTH, bottom),
        ("r_box_tr", x1, top), ("r_box_br", x1, bottom),
        ("r_box_tl", x1 - BOX_DEPTH, top), ("r_box_bl", x1 - BOX_DEPTH, bottom),
        ("l_pen_spot", SPOT_DEPTH, ym), ("r_pen_spot", x1 - SPOT_DEPTH, ym),
    ]
    return [(i, *p) for i, p in enumerate(points)]


@dataclass(frozen=True)
class FusionConfig:
    gap: float = 8.0
    min_confidence: float = 0.45
    max_moments: int = 25
    anchor_backoff: float = 6.0
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))


@dataclass(frozen=True)
class PadConfig:
    pre: float = 7.0
    post: float = 5.0
    goal_pre: float = 11.0
    goal_post: float = 7.0


@dataclass(frozen=True)
class AudioConfig:
    frame_seconds: float = 1.0
    hop_seconds: float = 0.5
    threshold: float = 2.2
    smoothing_seconds: float = 3.0
    min_gap: float = 25.0

    @property
    def smooth_rows(self) -> int:
        return max(1, int(self.smoothing_seconds / self.hop_seconds))

    @property
    def baseline_rows(self) -> int:
        return max(self.smooth_rows * 8, 60)


@dataclass(frozen=True)
class ReelConfig:
    target: float = 45.0
    max_seconds: float = 60.0
    per_item: float = 0.0


@dataclass(frozen=True)
class BrandConfig:
    """Texts of overlays and captions."""

    # Hook texts per kind, watermark, captions.
    hooks: dict = field(default_factory=lambda: {
        "goal": ["Spot the defender's mistake 👀", "Rate this finish 1-10 🔥", "Guess who scored 👇"],
        "chance": ["How did this NOT go in?? 😱", "Best save of the season?"],
        "skill": ["Watch the run, not the ball 🎯"],
    })
    watermark: str = "@yourchannel"
    intro_text: str = "YOUR CHANNEL"
    outro_text: str = "Follow for daily breakdowns"
    hashtags: tuple = ("#football", "#soccer", "#goal", "#highlights", "#tactics")
    caption_template: str = "{moment_type} breakdown — {hook}\n\n{hashtags}"
    hook_seconds: float = 1.6
    stat_step_px: int = 70
    show_hook: bool = True
    show_lower_third: bool = True
    show_minute: bool = True
    show_stats: bool = True
    show_shot_distance: bool = True
    show_sprint_distance: bool = True
    show_top_speed: bool = True
    show_players_beaten: bool = True
    show_watermark: bool = True
    card_seconds: float = 1.0
    freeze_seconds: float = 1.2


@dataclass(frozen=True)
class MomentConfig:
    fusion: FusionConfig = field(default_factory=FusionConfig)
    pads: PadConfig = field(default_factory=PadConfig)


def config_hash(cfg) -> str:
    """Stable short hash of a config object, part of the key of saved results."""
    body = cfg if isinstance(cfg, dict) else asdict(cfg)
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]
