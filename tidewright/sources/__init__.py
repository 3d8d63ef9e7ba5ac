"""Where series come from and are kept: tables, CSV files, the store and its lineage."""
