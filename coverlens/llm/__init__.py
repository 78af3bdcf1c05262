"""Operators for training-data pipelines. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions with them, so it need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
