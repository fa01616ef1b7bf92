"""Page quality, de-duplication and corpus operators on Spark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the Python workers by value: executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
