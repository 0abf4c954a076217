"""Part of braidline."""
