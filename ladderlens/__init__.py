"""Order-book liquidity analytics as PySpark DataFrame operators."""
