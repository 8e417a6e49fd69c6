"""Spark-native analytics over typed program graphs, traces and retrieval queries."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions for Python workers travel by value, so executors need no copy of this package. This holds for the whole process
# from the import on, and for this package only.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
