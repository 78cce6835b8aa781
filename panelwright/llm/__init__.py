"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value: a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
