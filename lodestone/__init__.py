"""lodestone: document retrieval and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels of this package travel inside the task, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
