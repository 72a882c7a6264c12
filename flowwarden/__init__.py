"""flowwarden: network-flow threat detection as Spark DataFrame operators.

Every public operator takes DataFrames and returns DataFrames.  ``operators`` holds single
relational steps, ``functions`` holds Column builders, ``plans`` composes them into the user-level
jobs, ``sources`` reads and writes tables, ``streaming`` runs the same plans on micro-batches.
"""

import sys

from pyspark import cloudpickle

# Arrow kernels are shipped by value, so a cluster needs no package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
