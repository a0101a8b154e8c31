"""Scans and sinks: parquet tensor tables, image files, parquet payloads, and
tensors derived from the driver's tables."""
