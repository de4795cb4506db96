"""Operators for preparing training text at scale. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel with the job, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
