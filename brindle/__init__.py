"""An analytics engine on PySpark."""
