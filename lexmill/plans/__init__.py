"""Relational operators that grammars need, and the registered queries."""
