"""Structured Streaming jobs."""

from aspectra.streaming.scoring import latest_by_key, read_state, stream_latest_state, stream_score

__all__ = ["latest_by_key", "read_state", "stream_latest_state", "stream_score"]
