"""Training-data pipeline operators. Nothing outside this subpackage imports it.

Functions of this subpackage travel to executors by value, so a task needs the
libraries of the cluster's Python only, not this package on its path."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
