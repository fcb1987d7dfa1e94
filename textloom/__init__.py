"""textloom: corpus preparation and retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so that a job does not depend on the package being installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
