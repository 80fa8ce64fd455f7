"""kestrel: Spark-native column selection and capacity analytics.

Every public operator takes and returns Spark DataFrames.  Heavy work
(aggregates, joins, windows, model fitting) runs as Spark jobs; only small
per-column result tables (one row per feature, per pair or per candidate
subset) are ever brought to the driver.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Serialise this package's functions by value inside Python tasks
    (``mapInPandas`` bodies, pandas UDFs), so executors run them without the
    package being installed or on their ``PYTHONPATH``."""
    import sys

    try:
        from pyspark import cloudpickle
    except Exception:  # noqa: BLE001 - Spark not importable: nothing to ship
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
