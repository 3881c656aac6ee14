"""DataFrame-to-DataFrame operators: stages, updates, key-space commands, geo searches."""
