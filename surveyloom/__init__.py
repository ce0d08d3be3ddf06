"""Survey analytics on Spark: a small metric DSL and the domain analytics around it."""
