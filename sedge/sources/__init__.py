from sedge.sources.tables import TABLES, table

__all__ = ["TABLES", "table"]
