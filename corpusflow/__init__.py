"""Spark jobs that prepare text collections for retrieval and answer questions over them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the task, so they need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
