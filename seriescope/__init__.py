"""Counts of distinct time series, and what a monitoring stream or a text corpus needs around them, on Spark."""

import sys

from pyspark import cloudpickle

# Functions go to the workers with their code, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
