"""rillspark: gridded-terrain and drainage analytics on PySpark.

Rasters are DataFrames of cells, flow networks are edge tables, and every
operator is a plan of joins, groupings and windows that Catalyst can optimise.
"""

import sys

from pyspark import cloudpickle

# Python functions that run inside tasks travel with the job, so executors need
# no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
