"""shopflow: retail order analytics as plain Spark DataFrame functions.

Nothing runs at import time. Every public function takes DataFrames (and plain
parameters) and returns a DataFrame; actions are left to the caller.
"""

from shopflow.schema import Tables

__all__ = ["Tables"]
