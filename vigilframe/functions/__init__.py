"""Part of vigilframe."""
