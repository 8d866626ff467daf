"""PySpark-native engine for time-and-space knowledge tables.

Functions that run inside tasks travel with the job (pickled by value), so
executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
