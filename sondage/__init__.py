"""sondage: code-intelligence analytics and corpus preparation on Spark DataFrames.

Importing the package starts nothing and imports no optional subpackage.
"""

__version__ = "0.1.0"
