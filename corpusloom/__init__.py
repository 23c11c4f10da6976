"""corpusloom: a PySpark-native engine that prepares and audits text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
