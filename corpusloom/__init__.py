"""Spark-native engine for building, filtering, scoring and evaluating training data.

Every transform takes and returns DataFrames (or Columns).  Functions that run in
Python workers are shipped by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
