"""Part of the brindle analytics engine."""
