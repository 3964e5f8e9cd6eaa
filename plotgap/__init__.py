"""Moving-platform discrepancy analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# ship the few Python task functions by value, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
