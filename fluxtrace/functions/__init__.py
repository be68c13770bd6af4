"""Scalar expressions and the few numerical kernels that Spark lacks."""
