"""Operators for training-data pipelines. Functions that run in tasks travel with the plan."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
