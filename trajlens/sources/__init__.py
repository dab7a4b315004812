"""Where tables come from and where results go."""

from trajlens.sources.tables import TableSet, read_table

__all__ = ["TableSet", "read_table"]
