"""Relational operators from paragraphs to cited answers."""
