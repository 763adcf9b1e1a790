"""Credential scanning over web content, and corpus preparation, as Spark dataflows."""
