"""Part of finrecon."""
