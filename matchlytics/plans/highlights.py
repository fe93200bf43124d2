"""End-to-end plans: detector inputs to signals, moments, clip analytics, reels and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AudioConfig, BrandConfig, ReelConfig
from ..functions.ordered import CHUNK, keys_of
from ..operators import audio, captions, effects, overlays, pitch, reel, scoreboard, stats, teams, tracking
from ..operators.fusion import detect_moments


def audio_signals(frames: DataFrame, cfg: AudioConfig | None = None, *, by="match_id",
                  chunk: int = audio.WINDOW_CHUNK, chunk_seconds: float = 3600.0) -> DataFrame:
    """Loudness frames (idx, t, rms) to audio signals; `idx` may have gaps."""
    cfg = cfg or AudioConfig()
    db = audio.loudness_db(frames, by=by, placed=True)
    z = audio.smoothed_z(db, "db", smooth=cfg.smooth_rows, baseline=cfg.baseline_rows, by=by, chunk=chunk, keep_chunk=True)
    peaks = audio.audio_peaks(z, thr=cfg.threshold, by=by, chunk=chunk)
    return audio.peak_signals(audio.merge_peaks(peaks, min_gap=cfg.min_gap, by=by, chunk_seconds=chunk_seconds), thr=cfg.threshold, by=by)


def scoreboard_signals(frames: DataFrame, *, every_s: float = 5.0, by="match_id") -> DataFrame:
    """Scoreboard texts per frame (idx, fps, seq, text) to score-change signals."""
    read = scoreboard.read_scores(scoreboard.sample_frames(frames, every_s=every_s))
    return scoreboard.score_changes(read, by=by)


def clip_analytics(players: DataFrame, ball_dets: DataFrame, clips: DataFrame, track_team: DataFrame | None = None,
                   homography: DataFrame | None = None, *, classes: DataFrame | None = None, features: DataFrame | None = None,
                   every: int = 1, by="clip_id", chunk: int = CHUNK) -> DataFrame:
    """Key player and stats of every clip.

    The ball comes from detections of the resolved `classes`. Teams are given, or found from the jersey vectors
    `features`. Maps of solved frames are smoothed and carried to the frames after them before they are used.
    """
    keys = keys_of(by)
    if features is not None:
        track_team = teams_of_tracks(features, by=by)
    if homography is not None:
        homography = pitch.smooth_homography(homography, every=every, by=by, chunk=chunk)
    ball = tracking.best_ball(ball_dets, classes, by=by)
    path = tracking.interpolate_ball(ball, by=by, chunk=chunk)
    key = (tracking.key_player(players, ball, clips, by=by) if track_team is None
           else tracking.key_player_possession(players, ball, clips, track_team, by=by)).select(*keys, "key_track_id")
    return stats.clip_stats(players, path, key, clips, homography, by=by, chunk=chunk)


def teams_of_tracks(features: DataFrame, k: int = 2, *, by="clip_id") -> DataFrame:
    """Jersey vectors (frame, track_id, feature) to one team per track, for `clip_analytics`."""
    votes = teams.team_vote(teams.team_kmeans(features, k, by=by), by=by)
    return votes.select(*keys_of(by), "track_id", "team")


def reel_plan(moments: DataFrame, cfg: ReelConfig | None = None, brand: BrandConfig | None = None, *,
              by="match_id") -> DataFrame:
    """Moments to the timeline of one reel per match, with its caption on every part.

    Segments count with their finished length, after slow motion and freeze frame. Where moments have a `status`,
    only rendered ones (ok) are taken; all are numbered.
    """
    keys, brand = keys_of(by), brand or BrandConfig()
    cuts = effects.finished_length(effects.cut_list(moments, by=by), freeze=brand.freeze_seconds).withColumn("ord", F.col("clip_no"))
    if "status" in moments.columns:
        cuts = cuts.filter("status = 'ok'")
    reels = reel.select_reel(cuts, cfg, by=by).groupBy(*keys).agg(reel.segments(), *overlays.reel_counts())
    reels = reels.withColumn("caption", overlays.reel_caption_text(brand))
    return reel.explode_parts(reels, reel.timeline_parts(brand), *keys, "n_moments", "n_goals", "caption")


def overlay_plan(cuts: DataFrame, clip_stats: DataFrame, brand: BrandConfig | None = None, *, by="match_id",
                 clip_key="clip_id") -> DataFrame:
    """Cut moments (with clip_no and a clip id) and clip stats to drawn texts, with the social caption of the clip.

    Hooks of a kind take turns within a match.
    """
    brand = brand or BrandConfig()
    keys = keys_of(by)
    # the moments of a match are its top k, so their turns are counted in one short window
    rows = captions.round_robin(cuts, brand.hooks, by=[*keys, "kind"], order=("t", "clip_no"), name="hook")
    rows = overlays.clip_caption(rows.join(clip_stats, clip_key, "left"), brand)
    return overlays.overlay_schedule(rows, brand, by=[*keys, "clip_no", clip_key, "caption"])


__all__ = ["audio_signals", "scoreboard_signals", "clip_analytics", "teams_of_tracks", "reel_plan", "overlay_plan", "detect_moments"]
