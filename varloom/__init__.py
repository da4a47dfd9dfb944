"""Spark-native engine for interval annotations, LD-aware regression and training-data preparation."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the Python workers by value, so a cluster needs no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
