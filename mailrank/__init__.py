"""Hybrid retrieval over mail and document tables, as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
