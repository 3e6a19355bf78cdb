"""Part of lithoframe."""
