"""Part of tracetide."""
