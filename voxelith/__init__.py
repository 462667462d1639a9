"""Voxelith: 3-D data processing on Spark DataFrames."""

__version__ = "0.1.0"
