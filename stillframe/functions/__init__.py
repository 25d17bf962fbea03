"""Part of the frame analytics engine."""
