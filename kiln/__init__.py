"""kiln: bulk tensor scoring on PySpark.

Read tensor tables or image files, preprocess them (reshape, rescale, resize,
centre crop, channel normalise, flatten), score them in batches with a shared
model, and write, drain or measure the result.
"""

from kiln.spec import TensorShapeError, TensorSpec

__all__ = ["TensorSpec", "TensorShapeError"]
