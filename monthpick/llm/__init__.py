"""Operators for large-scale training-data pipelines, one module per operator.

Nothing else in the library imports this subpackage.  ``queries.py`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""

import sys

from pyspark import cloudpickle

# functions sent to executors carry this subpackage's code, which need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
