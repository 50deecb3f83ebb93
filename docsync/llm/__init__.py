"""Operators for preparing training text: scoring, matching, deduplicating and mixing documents.

Nothing outside this folder imports it. Its functions travel to the executors by value, so an
executor needs Python and the libraries, but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
