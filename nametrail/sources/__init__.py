"""Log readers, normalization and writers."""

from nametrail.sources.load import detect_format, load_log
from nametrail.sources.normalize import empty_events, normalize_events
from nametrail.sources.sinks import export_alerts_csv, write_events
from nametrail.sources.zeek import ZeekHeader

__all__ = [
    "ZeekHeader", "detect_format", "empty_events", "export_alerts_csv",
    "load_log", "normalize_events", "write_events",
]
