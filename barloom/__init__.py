"""barloom: market-panel analytics written as PySpark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
