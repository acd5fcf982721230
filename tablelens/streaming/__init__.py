"""Streaming.

The reference has no streaming code (no watermark, window, state or late
data), so no streaming operator is built. The one place where new data arrives
over time is drift detection against a training snapshot; ``monitor`` runs
that same batch operator on each micro-batch of a Structured Streaming source.
"""
