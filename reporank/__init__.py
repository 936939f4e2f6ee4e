"""Ranking of code repositories against a problem statement, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with the plan, so the workers need
# numpy and pyarrow but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
