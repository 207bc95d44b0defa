"""Hybrid text retrieval and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
