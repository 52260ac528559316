"""Operators for preparing large text collections; nothing outside this folder imports it.

The functions that run in Python workers travel with their jobs by value, so executors need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
