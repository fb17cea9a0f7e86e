"""siftrank: retrieval evaluation and annotation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel with the job, so a cluster does not need
# this package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
