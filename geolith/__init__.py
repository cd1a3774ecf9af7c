"""geolith: spatial features, networks and vector files on DataFrames."""

__version__ = "0.1.0"
