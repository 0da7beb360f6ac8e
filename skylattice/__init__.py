"""Analytics over gridded, revisioned, time-stamped observations, as PySpark DataFrame operators."""
