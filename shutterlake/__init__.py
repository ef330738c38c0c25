"""shutterlake: analytics over large photo libraries and their forums, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run on executors travel with their code, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
