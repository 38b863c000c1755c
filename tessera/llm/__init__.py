"""Operators for preparing training text: deduplication, scans, extraction, language, mixing.

Each module holds one operator with its own interface; ``queries`` maps the registered
``opN_<name>`` queries onto them.
"""
