"""Document preparation for retrieval and training corpora, as Spark DataFrame operators.

Functions that run inside Python workers are shipped by value, so executors
need only the third-party libraries, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
