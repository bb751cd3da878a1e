"""Operators for large training corpora: archives, near copies, tokens, personal data,
fingerprints, URL rules, classifiers, mixing and exact search.

Nothing else in the package imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# executors get the functions of these modules by value; they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
