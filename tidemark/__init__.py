"""tidemark: market-news analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers need not have the package installed: its few helper functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
