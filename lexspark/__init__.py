"""Text analysis on Spark: lexing, segmentation, tagging and dependency parsing of Chinese and mixed-script corpora."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python workers get the library's functions with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
