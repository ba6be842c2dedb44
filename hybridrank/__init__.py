"""hybridrank — hybrid (sparse + dense) retrieval, rank fusion and query routing on Spark.

Every public operator takes DataFrames and returns DataFrames; nothing is collected to the driver.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions that run inside Python workers (the dense block scorer, user encoders) are shipped with
# the task by value, so executors need no copy of this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without by-value registration
    pass
