"""Tidemark: evidence-first search and corpus preparation as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
