"""Review and clickstream recommendation analytics as Spark jobs.

Every public function takes DataFrames and returns a lazy DataFrame. Nothing data-sized is collected,
nothing reads the wall clock, and no function keeps state between calls.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
