"""The SQL dialect: lexer, parser and declared types."""
