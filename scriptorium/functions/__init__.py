"""Scalar functions: Column expressions, and Arrow UDFs where offsets or Unicode forms need Python."""
