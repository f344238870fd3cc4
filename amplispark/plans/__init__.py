"""Registered queries: name -> (function of session and folder, DuckDB SQL or None)."""
