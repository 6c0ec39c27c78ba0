"""Tables that are written in versions."""
