"""Fitted components over streams."""
