"""mailvane: message-corpus analytics on Spark SQL.

Every operator is a DataFrame -> DataFrame or Column -> Column function.
"""

import sys as _sys

__version__ = "0.1.0"

try:  # ship the helpers of pandas UDFs by value, so workers need no installed package
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
