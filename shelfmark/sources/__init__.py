"""What is read and written: page snapshots, lists, catalogues, records, logs and runs."""
