"""The metric registry and the query DSL planned to DataFrames."""
