"""millrace: a Spark-native library of tabular analytics and machine-learning operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package go to executors by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
