"""vellum: a Spark-native engine for document consensus, lineage and corpus analytics."""

import sys

from pyspark import cloudpickle

# kernels travel to the executors with their code, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
