"""Where results go: tables and files, written once or appended to."""
