"""Review and question diagnostics, file inventory and text tables as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so those need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
