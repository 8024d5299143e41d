"""Event stream transforms, batch twins and streaming forms."""
