"""Part of cloudgrid."""
