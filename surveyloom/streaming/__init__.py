"""Appending imports as a stream: new survey files are folded into daily aggregates."""
