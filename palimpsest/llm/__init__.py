"""Operations for building training corpora: tokenising, filtering, deduplicating, packaging.

Nothing outside this subpackage imports it.
"""
