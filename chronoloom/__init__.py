"""Document chronology on Spark: tables of page lines in, an ordered, cited chronology out."""

import sys

from pyspark import cloudpickle

# The few Python kernels travel with their tasks, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
