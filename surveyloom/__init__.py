"""Exploration of survey-style tables on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
