from vintage.sources.transactions import (
    TXN_SCHEMA, conform, read_transactions, share_transactions, transactions, transactions_from_tables,
    write_transactions,
)

__all__ = ["TXN_SCHEMA", "conform", "read_transactions", "transactions_from_tables", "write_transactions",
           "share_transactions", "transactions"]
