"""Operators of a training-data pipeline: quality rules, BPE encoding, line
and substring dedup, a rule-ensemble classifier, licence scans, benchmark
decontamination, HTML extraction, near-duplicate detection and chat formatting.

Nothing else in the library imports this package. Its functions travel to the
executors by value, so a cluster needs numpy, pandas and pyarrow there but
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
