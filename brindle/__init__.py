"""brindle: a Spark-first relational analytics engine (DataFrame / SQL / Catalyst only in its core)."""
