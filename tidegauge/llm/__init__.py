"""Operators of a pipeline for training data. Their functions go to workers by value, so workers need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
