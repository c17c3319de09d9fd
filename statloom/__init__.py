"""statloom: statistics on Spark DataFrames, expressed as Catalyst aggregates with light vectorised finalizers."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
