"""cartlens: recommendation and catalogue analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (plus plain parameters);
nothing is collected to the driver except scalar boundaries (for example the
row count that fixes a temporal split point).
"""

__version__ = "0.1.0"

# Ship this package's functions to Python workers by value (grouped-map kernels
# such as the blocked top-k live here), so executors need no copy of the
# package on their path.
try:  # pragma: no cover - depends on the PySpark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
