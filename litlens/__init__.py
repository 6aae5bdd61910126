"""Retrieval evaluation and record resolution as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
