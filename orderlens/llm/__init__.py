"""Operators for preparing training text, apart from the order-line library."""

import sys

from pyspark import cloudpickle

# Tasks get these functions with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
