"""The catalog of models, the text form it is declared in, and schema migrations."""
