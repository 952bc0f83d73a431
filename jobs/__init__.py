"""Runnable jobs: each is a module with a command line, a config file and a function that takes a session."""
