"""Operators for preparing training text at scale; nothing else in the library imports them.

Functions of this package travel to the executors by value, so executors need the libraries only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
