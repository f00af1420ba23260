"""Tables whose rows carry a whole predicted probability distribution, on Spark."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
