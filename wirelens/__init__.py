"""Network-flow analytics as Spark jobs: packets -> flows -> scores -> explained verdicts."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to executors travel by value, so workers need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
