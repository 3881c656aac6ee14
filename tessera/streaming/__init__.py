"""Event streams, an extension to the batch engine."""
