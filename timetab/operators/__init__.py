"""DataFrame operators: each takes a DataFrame and returns one, or returns small fitted parameters."""
