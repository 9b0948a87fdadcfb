"""stratacat: set-based Spark plans over content-addressed file catalogs.

Functions that run on executors travel with their tasks, so executors need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
