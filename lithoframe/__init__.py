"""Lithoframe: spatial-layer analytics as DataFrame plans."""
