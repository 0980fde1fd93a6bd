"""Streaming entry points.

The evaluated workflow reads complete directories; there is no watermark,
window or state logic to carry.  The only streaming use is running the same
response-parsing operator over a folder that keeps receiving response files.
"""

from colsense.streaming.responses import finish_reason_stream  # noqa: F401
