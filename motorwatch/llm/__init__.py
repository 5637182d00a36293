"""Training-data operators: each module is one operator, ``queries`` registers them over the given tables.

Nothing else in the library imports this package. Its functions run inside Spark's Python workers,
so they travel by value: a worker needs no copy of the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
