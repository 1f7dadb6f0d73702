"""leafcut: page-level document analysis as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
