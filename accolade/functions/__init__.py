"""Parts of the award engine."""
