"""Training-data operators: deduplication, filtering, mixing, packing, secrets and personal data.

Nothing outside this subpackage imports it.  Each operator has a module of its own with a general
interface; ``queries`` holds the registered queries, built on those interfaces.
"""
