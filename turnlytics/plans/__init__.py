"""Registered queries, the chat tables they run on, and their SQL."""
