"""wordloom: corpus features and text classification as Spark DataFrame plans.

Tokens are rows, vocabularies and embedding tables are DataFrames, lookups are
joins, pooling is aggregation and contexts are offset joins.  Every public
function takes and returns DataFrames (or Columns) so that Catalyst plans the
whole chain.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a session works
# from any folder and on executors that do not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
