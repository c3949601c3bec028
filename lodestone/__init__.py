"""A package search and ranking engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
