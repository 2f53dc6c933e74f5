"""Part of ladderflow."""
