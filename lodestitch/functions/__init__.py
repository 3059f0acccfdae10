"""Part of lodestitch."""
