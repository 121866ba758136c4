"""Answers to the registered queries in plain SQL, written apart from the library's expressions."""
