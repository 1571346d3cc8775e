"""Review of large sets of submitted documents against a scoring table, on Spark.

Each operator is a function from DataFrame(s) to DataFrame with plain parameters: it declares
a plan and runs nothing. The few places that run a small job say so in their docstring.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
