"""Operators for preparing training data at scale, their queries and their oracle SQL."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel with their tasks, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
