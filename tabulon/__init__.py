"""Table operators on Spark for question-driven business analytics.

Functions of this package that run inside tasks travel to the executors by value,
so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
