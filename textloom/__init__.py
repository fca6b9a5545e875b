"""A PySpark-native engine for exploring code, documents and schemas as data."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so the library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
