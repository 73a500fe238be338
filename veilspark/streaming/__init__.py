"""Stateless streaming form of the redaction job."""
