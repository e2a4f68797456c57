"""Part of spanfold; see the package docstring."""
