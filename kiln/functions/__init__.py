"""Tensor functions in two forms: vectorised NumPy (``ndarray``) and native
Catalyst expressions (``native``), plus the composed ``Preprocess`` and image
byte helpers (``png``)."""

from kiln.functions.preprocess import IMAGENET_MEAN, IMAGENET_STD, Preprocess

__all__ = ["Preprocess", "IMAGENET_MEAN", "IMAGENET_STD"]
