"""Spark-native engine for regulatory genomics: DataFrame -> DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
