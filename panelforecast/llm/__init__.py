"""Operators of a training-data pipeline over documents, pages and vectors.

The functions that run inside tasks travel to the executors by value, so that the
package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
