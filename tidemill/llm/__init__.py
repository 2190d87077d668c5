"""Operators for building training corpora at scale.

Nothing outside this subpackage imports it.  Each module holds one operator with
its general interface; ``queries`` registers one thin query per operator.
"""
