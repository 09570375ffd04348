"""Training-data operators: each module holds one operator; ``queries`` registers them.

Functions of this package are pickled by value, so executors need numpy and pyarrow
but no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
