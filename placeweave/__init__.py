"""Record linkage, geo-candidate ranking and listing curation as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Executors receive the few Arrow helpers by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
