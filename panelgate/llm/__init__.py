"""Operators of a training-data pipeline on tables of documents and web pages.

Nothing else in the library imports this subpackage. Functions that run in
Python workers travel with their tasks, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
