"""factloom: bi-temporal, append-only fact logs as Spark DataFrames."""
