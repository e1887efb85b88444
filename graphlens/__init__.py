"""Spark-native analytics over code graphs, findings, retrieval units and dependency data."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
