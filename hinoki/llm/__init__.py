"""Training-data operators.  Outside this package only the catalog uses it, for `common.materialize`.

The functions that run on executors are pickled by value, so a cluster needs
no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
