"""Part of tessera; see the package README."""
