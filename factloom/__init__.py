"""A Spark engine for building and querying a knowledge base of grounded facts.

Python functions of this package travel to executors by value, so they run where the package is not installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
