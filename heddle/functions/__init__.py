"""Scalar functions: columns in, columns out. Nothing here reads data."""

import sys

from pyspark import cloudpickle

# What runs in Python workers is sent to them by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
