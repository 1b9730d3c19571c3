"""DataFrame-to-DataFrame operators for tables, sequences and genomic intervals on Spark."""
