"""Change feeds, subscriptions, live queries and replay."""
