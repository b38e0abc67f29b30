"""Preference-data and diversity analytics, and training-data operators, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the tasks: workers need no install of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
