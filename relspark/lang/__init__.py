"""The relational script language: lexer, syntax tree and parser."""
