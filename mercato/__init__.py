"""mercato: commerce and delivery analytics as PySpark DataFrame operators."""

import sys as _sys

try:
    # Functions handed to Python workers (mapInPandas, applyInPandasWithState) are pickled by value, so
    # executors do not need this package installed or on their path.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: workers then import the package by name
    pass
