"""Corpus operators for large-scale training-data preparation.

One module per operator; ``queries`` registers the ``opN_<name>`` queries. The
rest of the library never imports this subpackage.
"""
