"""Operators for large training-data pipelines.

Each operator works on ``documents`` (doc_id, text, ...) or ``embeddings`` and
is independent of the rest of the library, which never imports this package.
``queries`` registers one query per operator plus the pipeline.

Functions that run inside Spark tasks are shipped by value, so executors need
only the third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])
