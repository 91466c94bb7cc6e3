"""Measurement-evidence analytics on PySpark.

Layout
------
``functions``  column expressions (cleaning, units, keys, rules, text analysis)
``operators``  DataFrame-in / DataFrame-out operators
``sources``    readers, writers and catalog helpers
``plans``      the bronze -> silver -> gold -> relationship -> serving plans
``entries``    the registered queries and their SQL twins
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs
# no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
