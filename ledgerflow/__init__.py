"""ledgerflow: analytics over financial ledgers as DataFrame and SQL expressions."""
