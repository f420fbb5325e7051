"""Operations for preparing language-model training corpora at scale.

Every module holds one operator with its own interface; ``queries`` registers a
thin query per operator.  Nothing outside this subpackage imports it.
"""
