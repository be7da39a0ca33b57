"""Plans of the message-store engine."""
