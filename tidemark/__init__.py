"""tidemark: market analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames, works on all rows of all symbols
in one job and never reads the clock: reference times are arguments.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the workers with the job, so the executors
# need no copy of it on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
