"""Sources of the message-store engine."""
