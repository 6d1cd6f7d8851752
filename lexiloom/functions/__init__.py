"""Part of lexiloom; see README.md."""
