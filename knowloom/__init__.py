"""knowloom: document collections to reviewable knowledge, as Spark DataFrame operators.

Every operator is a lazy ``(DataFrame..., params) -> DataFrame`` function over whole tables.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Column functions travel to Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
