"""The engine is batch only: its operators define no streams, windows or late data."""
