"""Part of the band engine."""
