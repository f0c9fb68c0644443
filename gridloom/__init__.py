"""gridloom: analysis-ready raster tables on Spark.

One pixel observation is one row. Every operator is a function from DataFrame
to DataFrame, so it composes with ``DataFrame.transform`` and stays lazy.
"""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with their task, so
# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
