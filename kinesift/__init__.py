"""Evidence analytics over sensor and event logs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the task, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
