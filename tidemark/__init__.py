"""tidemark: a Spark-native engine for data-quality audits.

Plant known errors in a table, rank suspicious rows and row pairs with
DataFrame detectors, join the rankings against the truth and report ranking
metrics and significance tests. Every operator is a lazy
``DataFrame -> DataFrame`` function with an explicit seed.
"""

from tidemark.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]


def _ship_code_by_value() -> None:
    """Pickle this package's functions by value for Python workers.

    Kernels (``mapInPandas``, ``applyInPandas``) are defined in this package;
    workers that do not have it on their path (an entry point imported from
    another directory, or executors without the package installed) can still
    run them.
    """
    try:
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: rely on the import path
        pass


_ship_code_by_value()
