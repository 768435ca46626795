"""Operators for preparing training text: de-duplication, decontamination,
quality, licences, secrets, mixing, token counts and web archives.

Nothing outside this package imports it.
"""
