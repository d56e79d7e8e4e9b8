"""weft: table analytics as lazy Spark DataFrame operators."""
