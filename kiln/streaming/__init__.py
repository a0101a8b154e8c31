"""Batch streams through the Python worker: exact model batches (B2), overlap of
fetch and compute (B7), and draining a result batch by batch (S8).

The reference has no streaming query (no readStream, watermark or state); its
only stream is the flow of Arrow batches through a scoring task, which is what
this package handles.
"""

from kiln.streaming.batches import drain, ipc_cells, iter_batches, prefetch, rebatch, rebatch_arrays, rebatch_series

__all__ = ["drain", "ipc_cells", "iter_batches", "prefetch", "rebatch", "rebatch_arrays", "rebatch_series"]
