"""Readers and writers: DOCX folders, JSON artifacts, evaluation cases."""
