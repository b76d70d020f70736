"""DataFrame operators for single-cell and spatial tissue-imaging tables on Spark."""

import sys

from pyspark import cloudpickle

# Small Python helpers travel to the executors with the task; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
