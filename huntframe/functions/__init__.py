"""Part of huntframe."""
