"""Grammar operators: column rules that compile to native expressions, and a cursor for recursive formats."""
