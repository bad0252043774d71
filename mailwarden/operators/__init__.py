"""Table-level operators: each is DataFrame in, DataFrame out."""
