"""gridloom: dense numeric work and the record-keeping around it, as Spark plans."""
