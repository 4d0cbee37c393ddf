"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Functions that run inside tasks
are shipped by value, so executors need numpy and pyarrow but not this package
on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
