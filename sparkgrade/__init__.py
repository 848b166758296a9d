"""sparkgrade: evaluate question-answering systems with PySpark DataFrames.

Sub-packages
------------
functions   column expressions (text, answers, symbols, labels, order keys)
sources     readers and writers for datasets, reviews, logs and reports
operators   DataFrame -> DataFrame transformations
plans       whole jobs composed of operators
streaming   the incremental forms (Structured Streaming)
catalog     the queries bound to the test tables, with their SQL twins
"""

import sys

from pyspark import cloudpickle

# Python functions that run inside tasks travel by value, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
