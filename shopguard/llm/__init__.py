"""Operators and queries of a training-data pipeline.

Nothing else in the package imports this subpackage. Functions of these
modules that run in Python workers travel by value, so a worker needs no
installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
