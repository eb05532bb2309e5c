"""Training-data operators: one module each, and the thin contract queries in :mod:`.queries`."""
