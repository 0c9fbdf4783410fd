"""Rule matching, expansion, q-grams, orders, verifiers and join strategies, as functions of DataFrames."""
