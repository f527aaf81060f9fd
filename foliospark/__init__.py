"""foliospark: retrieval, knowledge-graph and corpus analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
