"""Maximum-inner-product search over sparse and dense vectors, and its evaluation, on Spark.

Functions of this package are pickled by value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
