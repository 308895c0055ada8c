"""Tables of programming instructions and generated Python code, on Spark."""
