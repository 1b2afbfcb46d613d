"""Operators for preparing training data: deduplication, filters, mixing, scoring and encoding."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with them, so executors need no copy of this folder
cloudpickle.register_pickle_by_value(sys.modules[__name__])
