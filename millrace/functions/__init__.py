"""Column functions: words, fields, host names, hashes."""

from .text import (
    base_name,
    go_lower,
    host_name,
    key_hash,
    pair_fields,
    reducer_of,
    tab_field,
    tab_fields,
    text_name,
    white_fields,
    words,
)

__all__ = [
    "base_name", "go_lower", "host_name", "key_hash", "pair_fields", "reducer_of", "tab_field", "tab_fields", "text_name",
    "white_fields", "words",
]
