"""Scalar column functions and small numpy kernels that run inside tasks."""
