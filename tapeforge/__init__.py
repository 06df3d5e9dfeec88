"""tapeforge: bar-table pattern analytics expressed as Spark DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions handed to applyInPandas travel by value, so executors need no copy
# of this package on their Python path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
