"""Part of factloom; see README.md."""
