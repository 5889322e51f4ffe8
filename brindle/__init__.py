"""Part of brindle, an analytics engine on PySpark."""
