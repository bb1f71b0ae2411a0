"""Operators for preparing training text at scale. Nothing else in the library imports this package.

Functions that run in Python workers are sent by value, so a cluster's workers
need numpy, pyarrow and the tokenizing libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
