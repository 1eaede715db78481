"""Spark-native analytics for transcribed historical documents and training-data corpora.

Functions of this package that run in Python workers are pickled by value, so an
executor needs no copy of the repository on its import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
