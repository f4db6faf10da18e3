"""Part of loomwork."""
