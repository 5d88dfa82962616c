"""Generalised LL parsing of source files: engine, lexers and dialect grammars."""
