"""Streaming forms of the sources, features and detectors."""

from nametrail.streaming.live import (
    detect_on_batches,
    flag_events,
    nxdomain_windows,
    stream_log,
    traffic_counts,
    tunneling_sessions,
    without_duplicates,
)
from nametrail.streaming.stateful import beacon_state, burst_state, use_state_store

__all__ = [
    "beacon_state", "burst_state", "detect_on_batches", "flag_events", "nxdomain_windows",
    "stream_log", "traffic_counts", "tunneling_sessions", "use_state_store", "without_duplicates",
]
