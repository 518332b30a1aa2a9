"""Training-data operators: tokens, duplicates, quality, secrets, language models and shards.

Nothing outside this subpackage imports it. `queries` registers one query per operator.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
