"""Part of weft."""
