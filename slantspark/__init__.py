"""slantspark: Spark-native political-slant text analytics.

Reads article and label tables, cleans and joins them, turns each text into
26 lexical / punctuation / part-of-speech / phrase / entity features with
native column expressions, trains and evaluates Spark ML classifiers and
scores new text in batch or as a stateless stream.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers on any
    executor can run our Arrow-batched helpers without the package installed."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark always bundles it
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
