"""A Spark-first analytics engine for timestamped, sparsely populated rows.

Functions shipped to Python workers are pickled by value, so executors need no copy of the package.
"""

import chronofold as _self
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(_self)
