"""Vehicle-safety analytics on Spark: feeds, typed tables, star schema, corpus, monitoring.

Functions of this package that run in Python workers travel by value: a session started from any
folder can use it, and workers need no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
