"""Readers of posting pages, feeds and queues."""
