"""Operators of the message-store engine."""
