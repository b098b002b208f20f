"""A PySpark-native analytics engine for vector features, rasters and multidimensional arrays."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
