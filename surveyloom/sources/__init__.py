"""Tables and files that queries read, and files they write."""
