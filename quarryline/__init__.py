"""quarryline: document-corpus preparation and batch hybrid retrieval on PySpark.

Functions of this package that run in Python workers travel by value, so executors need
no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
