"""Spark-native curation, packing and evaluation analytics for multimodal training data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so it needs to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
