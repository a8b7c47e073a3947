"""countweave: sensor-count panels on Spark.

Functions of this package that run inside Python workers are pickled by value, so
executors need only Spark, numpy, pandas and pyarrow, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
