"""rulegrid: a PySpark-native analytics engine for regulatory rule graphs.

Operators are plain functions ``(DataFrame, ...) -> DataFrame``. What goes through the driver is bounded by a documented
parameter (a sample, a tree, a list of test items); lineage is cut by tables in the shared folder.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that only the driver needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
