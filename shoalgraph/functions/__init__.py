"""Part of shoalgraph."""
