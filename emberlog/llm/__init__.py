"""Operators for preparing training text, and their registered queries.

Nothing else in the library imports this package. Its functions are pickled by value, so tasks
run them without the package being installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
