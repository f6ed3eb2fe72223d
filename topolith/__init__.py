"""Vector topology checks and corpus operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that no executor needs
# the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
