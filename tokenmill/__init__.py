"""tokenmill: Spark jobs for training-corpus, conversation and evaluation tables."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
