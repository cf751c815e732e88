"""Operators of a training-data pipeline: search, quality, licences, archives, toxicity, copies, tokens, packing, mixing, web text.

Nothing else in the library imports this package. Its functions travel to the executors by value, so only the driver
needs the package; the executors need numpy, pyarrow and the tokenizer libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
