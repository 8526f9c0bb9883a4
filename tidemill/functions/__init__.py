"""Functions that Spark SQL lacks or spells differently."""
