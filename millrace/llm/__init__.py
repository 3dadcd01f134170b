"""Operators for preparing training corpora: search, extraction, counting, deduplication,
decontamination, personal data, tokenisation, language identification and sharding.

Nothing else in the library imports this subpackage."""
