"""Operators for large training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors whole, so that they need no copy
# of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
