"""Turnwise: conversation analytics as Spark logical plans.

Importing the package is cheap; every operator takes and returns DataFrames and
nothing runs before an action.  The ``llm`` subpackage is optional: no other
module imports it.
"""

__version__ = "0.1.0"
