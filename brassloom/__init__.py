"""Part of brassloom."""
