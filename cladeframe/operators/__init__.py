"""Part of cladeframe."""
