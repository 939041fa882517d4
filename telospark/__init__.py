"""Spark-native analytics for protein termini, coding variants and permutation tests."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
