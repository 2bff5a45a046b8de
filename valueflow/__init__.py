"""valueflow: household value-flow analytics on Spark DataFrames."""

from .sources.ledger import Ledger  # noqa: F401

__version__ = "0.1.0"
