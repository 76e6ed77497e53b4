"""larkspur: a Spark-native engine for relational, graph-pattern and fuzzy queries.

Functions that run on executors are shipped by value, so executors need Spark's
Python environment but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
