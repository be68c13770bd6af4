"""Incremental forms: binning, event leaders and upserts over Structured Streaming."""
