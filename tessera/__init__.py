"""Tessera: a PySpark-native engine for document retrieval, claim intake and its evaluation."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
