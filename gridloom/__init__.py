"""gridloom: grid, rule-set and record analytics expressed as Spark plans."""
