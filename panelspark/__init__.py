"""Cross-sectional panel analytics as Spark DataFrame operators.

Every public function maps DataFrames to DataFrames.  Panels are long tables keyed by
``date`` and ``asset`` (plus ``scenario`` where several variants run in one job).
"""

__version__ = "0.1.0"
