"""Training-data operators: dedup, classifiers, tokens, packing, mixing, LM scoring, ANN.

Nothing else in the library imports this subpackage.
"""
