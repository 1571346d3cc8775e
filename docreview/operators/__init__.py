"""The relational operators, one module per stage."""
