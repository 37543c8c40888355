"""tessel: DataFrame operators for collections of embedded items, their groups, clusters and folders."""

__version__ = "0.1.0"
