"""Operators of a training-data pipeline over `documents` and `benchmark`.

Python functions of this package travel with the plan (they are pickled by value), so
executors need numpy, pyarrow and the tokenizer library, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
