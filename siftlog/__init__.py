"""siftlog: security-log interpretation and analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow functions travel to the executors by value: the workers need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
