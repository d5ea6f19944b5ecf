from coursemill.sources.names import sanitise, syntactic_names
from coursemill.sources.readers import (
    read_crosswalk,
    read_folder,
    read_positional,
    read_table,
    union_by_name,
)
from coursemill.sources.writers import write_csv, write_keys, write_table

__all__ = [
    "read_crosswalk", "read_folder", "read_positional", "read_table", "sanitise",
    "syntactic_names", "union_by_name", "write_csv", "write_keys", "write_table",
]
