"""Training-data operators: ten document-level components for corpus pipelines.

Nothing else in the library imports this subpackage.  Functions shipped to
Python workers are pickled by value, so executors need no copy of the package.
"""

import chronofold.llm as _self
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(_self)
