"""Stateful and time-driven operators over event logs, in batch and streaming form."""
