"""Operators of a training-data pipeline: packing, repeated passages, mixing, id files, near copies, tool calls,
personal data, nearest neighbours, quality, secrets.  Nothing else in the library imports this subpackage."""
