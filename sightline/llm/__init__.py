"""Training-data operators: ten text-corpus operations and the pipeline that strings five of them together.

Nothing outside this folder imports it, so it can be removed whole.
"""
