"""Operators of a training-data pipeline.

Functions that run in Spark's Python workers are sent by value, so that the
package need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
