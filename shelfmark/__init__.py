"""Catalogue reconciliation on Spark: match file inventories against catalogues of expected files."""
