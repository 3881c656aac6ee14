"""Document and key-space analytics, declared as DataFrame plans."""
