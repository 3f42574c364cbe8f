"""Interval, sequence-graph and similarity analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
