"""Part of pubspark."""
