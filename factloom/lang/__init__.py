"""A tolerant reader of Java sources: tokens, declarations, calls and data flow."""
