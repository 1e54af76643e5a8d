"""Tables and files as DataFrames."""
from paperlane.sources.tables import table  # noqa: F401
