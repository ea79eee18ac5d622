"""grainmill: table checking, cleaning and analysis on Spark DataFrames."""

from grainmill.session import local_session

__all__ = ["local_session"]
